"""A feed of keyed changes applied to a versioned snapshot.

Every micro-batch writes one new version of the snapshot and then moves the pointer to it, so a
batch that runs twice makes the same version twice, readers see whole versions, and no lineage grows.
Within a batch the sequence column decides; batches follow each other.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.operators.mutations import as_patches, removed, upserted
from quarrygrid.schema import col


class SnapshotStore:
    """Versions of a keyed table as Parquet folders below a path on storage that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, keep: int = 3):
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), key, keep
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first: a version counts once its writer has marked it."""
        root = self._fs_path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._fs_path(f"{self.path}/{n}/_SUCCESS")))

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._fs_path(f"{self.path}/v={old}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no snapshot in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={found[-1] if version is None else version}")

    @property
    def version(self) -> int:
        return (self.versions() or [-1])[-1]


def apply_batch(store: SnapshotStore, changes: DataFrame, batch: int, seq: str | None = "seq", removal: str | None = None, on_change: Callable[[DataFrame, int], None] | None = None) -> None:
    """Version batch + 1 from version batch (or the newest before it): removals first, then upserts.

    removal: a boolean column that marks rows whose key is to go; on_change gets the changed keys.
    """
    base = max([v for v in store.versions() if v <= batch], default=None)
    if base is None:
        raise FileNotFoundError("the store has no version to start from")
    snapshot = store.read(base)
    rows = changes
    if removal:
        gone = changes.where(F.coalesce(col(removal), F.lit(False))).select(col(store.key))
        snapshot = removed(snapshot, gone, store.key)
        rows = changes.where(~F.coalesce(col(removal), F.lit(False))).drop(removal)
    names = [c for c in rows.columns if c in snapshot.columns or c == seq]
    store.write(upserted(snapshot, as_patches(rows.select(*map(col, names)), seq), store.key), batch + 1)
    if on_change:
        on_change(changes.select(col(store.key)).distinct(), batch + 1)


def apply_feed(changes: DataFrame, store: SnapshotStore, checkpoint: str, trigger: dict | None = None, **options):
    """Starts a query that applies a stream of changes; trigger: e.g. {'processingTime': '1 second'}."""
    writer = changes.writeStream.foreachBatch(lambda df, batch: apply_batch(store, df, batch, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def folder_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(os.fspath(path))
