"""Keyed changes: partial upserts and removals over a snapshot.

A patch row says which columns it brings (`present`), so an explicit null is not an absent value.  For
each key and column the patch with the highest sequence number that brings the column wins.  The
snapshot itself is joined with the patches' keys only; where those are few, it is not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygrid.model import Transaction
from quarrygrid.schema import SPARK_TYPES, col, coerced, project_rows, schema_keys

PRESENT, SEQ = "__present", "__seq"


def patch_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: Mapping[str, str], key: str, first_seq: int = 0) -> DataFrame:
    """Patch rows as a frame; rows without a key are dropped, keys outside the schema too."""
    names = schema_keys(schema, key)
    kind = T.StructType([*[T.StructField(n, SPARK_TYPES[schema.get(n, "string")]) for n in names], T.StructField(PRESENT, T.ArrayType(T.StringType())), T.StructField(SEQ, T.LongType())])
    data = []
    for k, r in enumerate(project_rows(rows, names)):
        if r.get(key) not in (None, ""):
            data.append((*[coerced(r.get(n), schema.get(n)) if schema.get(n) != "string" else r.get(n) for n in names], [n for n in names if n in r], first_seq + k))
    return spark.createDataFrame(data, kind)


def as_patches(df: DataFrame, seq: str | None = None) -> DataFrame:
    """Whole rows as patches that bring every column; seq: the column that orders them.

    Rows of a frame have no order of their own: without seq, which of equal keys wins is decided by a hash of
    the row, the same in every run.
    """
    names = [c for c in df.columns if c != seq]
    return df.select(*[col(c) for c in names], F.array(*map(F.lit, names)).alias(PRESENT), (col(seq).cast("long") if seq else F.xxhash64(*map(col, names))).alias(SEQ))


def merged(patches: DataFrame, key: str) -> DataFrame:
    """One row a key: `__v` the winning value and `__h` whether any patch brings it, for every other column."""
    names = [c for c in patches.columns if c not in (key, PRESENT, SEQ)]
    aggregates = []
    for k, n in enumerate(names):
        seq = F.when(F.array_contains(PRESENT, n), F.col(SEQ))
        # The struct keeps an explicit null of the winning patch.
        aggregates += [F.max_by(F.struct(col(n).alias("v")), seq)["v"].alias(f"__v{k}"), F.max(seq).isNotNull().alias(f"__h{k}")]
    return patches.where(col(key).isNotNull()).groupBy(col(key).alias("__patch")).agg(*aggregates)


def upserted(snapshot: DataFrame, patches: DataFrame, key: str, few: bool = False) -> DataFrame:
    """The snapshot with the patches: known keys column by column, new keys as new rows.

    One outer join, which reads the snapshot once.  few: the caller has bounded the patches; they are sent to
    the snapshot, which is not shuffled, and its keys are read once more to tell which patches are new rows.
    """
    order = [c for c in patches.columns if c not in (key, PRESENT, SEQ)]
    at = {n: k for k, n in enumerate(order)}
    own = merged(patches, key)
    if not few:
        types = {f.name: f.dataType for f in snapshot.schema.fields}
        out = snapshot.withColumn("__old", F.lit(True)).join(own, col(key) == F.col("__patch"), "full_outer")
        value = lambda c: F.when(F.coalesce(F.col(f"__h{at[c]}"), F.lit(False)), F.col(f"__v{at[c]}")).otherwise(col(c)).cast(types[c])
        return out.select(*[(F.when(F.col("__old"), col(c)).otherwise(F.col("__patch")).cast(types[c]) if c == key else value(c) if c in at else col(c)).alias(c) for c in snapshot.columns])
    own = F.broadcast(own)
    new_value = lambda n: F.col(f"__v{at[n]}") if n in at else F.lit(None)
    types = {f.name: f.dataType for f in snapshot.schema.fields}
    kept = snapshot.join(own, col(key).eqNullSafe(F.col("__patch")), "left").select(*[col(c) if c == key or c not in at else F.when(F.coalesce(F.col(f"__h{at[c]}"), F.lit(False)), new_value(c)).otherwise(col(c)).cast(types[c]).alias(c) for c in snapshot.columns])
    seen = snapshot.select(col(key).alias("__seen")).join(F.broadcast(own.select(F.col("__patch").alias("__of"))), F.col("__seen") == F.col("__of"), "left_semi")
    fresh = own.join(F.broadcast(seen.distinct()), F.col("__patch") == F.col("__seen"), "left_anti")
    fresh = fresh.select(*[F.col("__patch").cast(types[key]).alias(key) if c == key else new_value(c).cast(types[c]).alias(c) for c in snapshot.columns])
    return kept.unionByName(fresh)


def removed(snapshot: DataFrame, ids: DataFrame | Sequence[Any], key: str) -> DataFrame:
    """The snapshot without the keys; rows may be given in place of their keys."""
    if not isinstance(ids, DataFrame):
        values = [i[key] if isinstance(i, Mapping) else i for i in ids]
        values = [v for v in values if v is not None]
        if not values:
            return snapshot
        kind = snapshot.schema[key].dataType
        text = isinstance(kind, T.StringType)
        ids = snapshot.sparkSession.createDataFrame([(str(v),) for v in values], "__removed string").select(F.col("__removed") if text else F.col("__removed").try_cast(kind).alias("__removed"))
    else:
        ids = ids.select(ids.columns[0]).toDF("__removed")
    return snapshot.join(ids.distinct(), col(key) == F.col("__removed"), "left_anti")


def collapsed(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the last one by `order`; where none is given, by a hash of the row, the same in every run."""
    rest = [c for c in df.columns if c != key]
    seq = col(order) if order else F.xxhash64(*map(col, rest))
    best = df.groupBy(col(key)).agg(F.max_by(F.struct(*[col(c) for c in rest]), seq).alias("best"))
    return best.select(*[col(key) if c == key else F.col("best").getField(c).alias(c) for c in df.columns])


def apply_transaction(snapshot: DataFrame, tx: Transaction | Mapping[str, Any], schema: Mapping[str, str], key: str) -> DataFrame:
    """Removes, then added and updated rows in the order given."""
    tx = Transaction.of(tx)
    out = removed(snapshot, tx.remove, key)
    rows = [*tx.add, *tx.update]
    return upserted(out, patch_frame(snapshot.sparkSession, rows, schema, key), key) if rows else out


class Pending:
    """Changed rows that wait on the driver, one entry a key, until they are written into the snapshot.

    However many changes there were, the table is the snapshot joined once with what is pending, and
    a change costs what it holds.  Entries: whether the snapshot's row is gone, and the columns brought since.
    """

    #: Column types whose values can be keys here; other keys take the way of frames.
    KEYS = ("string", "integer", "float")

    def __init__(self, schema: Mapping[str, str], key: str):
        self.schema, self.key, self.rows = schema, key, {}

    def __len__(self) -> int:
        return len(self.rows)

    def _key(self, value: Any) -> Any:
        kind = self.schema.get(self.key, "string")
        return None if value in (None, "") else str(value) if kind == "string" else coerced(value, kind)

    def upsert(self, rows: Sequence[Mapping[str, Any]]) -> None:
        for r in project_rows(rows, schema_keys(self.schema, self.key)):
            if (k := self._key(r.get(self.key))) is not None:
                own = self.rows.setdefault(k, (False, {}))[1]
                own.update({n: v if self.schema.get(n) == "string" else coerced(v, self.schema.get(n)) for n, v in r.items() if n != self.key} | {self.key: k})

    def remove(self, ids: Sequence[Any]) -> None:
        for i in ids:
            if (k := self._key(i.get(self.key) if isinstance(i, Mapping) else i)) is not None:
                self.rows[k] = (True, {})

    def over(self, snapshot: DataFrame) -> DataFrame:
        """The snapshot with all that is pending; the entries are few, and sent to it."""
        spark, names = snapshot.sparkSession, schema_keys(self.schema, self.key)
        if gone := [(k,) for k, (cut, _) in self.rows.items() if cut]:
            kind = T.StructType([T.StructField("__gone", snapshot.schema[self.key].dataType)])
            snapshot = snapshot.join(F.broadcast(spark.createDataFrame(gone, kind)), col(self.key) == F.col("__gone"), "left_anti")
        rows = [own for _, own in self.rows.values() if own]
        return upserted(snapshot, patch_frame(spark, rows, {n: self.schema.get(n, "string") for n in names}, self.key), self.key, few=True) if rows else snapshot


def coalesced(transactions: Sequence[Transaction | Mapping[str, Any]], key: str) -> list[Transaction]:
    """A burst as few transactions as keep its order: a removal closes one only if it meets a change before it."""
    out: list[Transaction] = []
    for tx in map(Transaction.of, transactions):
        last = out[-1] if out else None
        gone = {i[key] if isinstance(i, Mapping) else i for i in tx.remove}
        touched = {r.get(key) for r in (*last.add, *last.update)} if last else set()
        if last and not gone & touched:
            rows = [*last.add, *last.update, *tx.add, *tx.update]
            out[-1] = Transaction((), tuple(rows), (*last.remove, *tx.remove))
        else:
            out.append(tx)
    return out


def changed_keys(tx: Transaction | Mapping[str, Any], key: str) -> tuple[list[Any], bool]:
    """(keys of added and updated rows, whether a full refresh is needed because rows went)."""
    tx = Transaction.of(tx)
    return [r[key] for r in (*tx.add, *tx.update) if r.get(key) not in (None, "")], bool(tx.remove) or not (tx.add or tx.update)
