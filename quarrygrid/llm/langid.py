"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded sample of its training
texts, in lower case.  A text is compressed whole with each dictionary, and the one that makes it smallest names
its language; where the margin to the next is narrow, the answer is rejected.

Defined results: a null text, or one without a letter, is `und` with score 0; equal sizes go to the
language that is first by code point, with score 1 / languages at most; rows with equal doc_id are
judged each on its own, and null doc_ids train as others do; with no training text at all every row is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import renamed, rows


def sample(docs: DataFrame, trains: Column, per_language: int = 120, most_languages: int = 200, each: int = 2048) -> dict[str, list[str]]:
    """Training texts by language: of each, the per_language rows that come first by a hash of doc_id and text.

    Of a text longer than `each` characters, as many are taken from a place that the hash chooses.  Rows are
    counted by language first; of a large one only hashes small enough for some eight times per_language
    rows go on, so that no task gets more, however many partitions there are.  What reaches the driver is
    bounded by per_language * most_languages * each characters; more than most_languages languages are an error.
    """
    known = renamed(docs, ["doc_id", "text", "lang"]).where(trains & F.col("lang").isNotNull())
    counts = known.where(F.col("text").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    # Equal rows have equal hashes: of a language that is mostly one text, few or all rows may pass.
    bound = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1 << 40, (8 * per_language << 40) // r.n)))])
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - (each - 1))).cast("int") + 1
    known = known.where(F.col("text").isNotNull()).select("lang", F.pmod(h, F.lit(1 << 40)).alias("h"), F.col("doc_id").alias("id"), F.col("text").substr(place, F.lit(each)).alias("piece"))

    def taken(rows_: DataFrame) -> list:
        first = rows_.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "piece"))).where(F.col("nth") <= per_language)
        return first.select("lang", "nth", "piece").collect()

    found = taken(known.where(F.col("h") < F.element_at(bound, F.col("lang"))))
    got = Counter(r.lang for r in found)
    if few := [r.lang for r in counts if got[r.lang] < min(per_language, r.n)]:
        found = [r for r in found if r.lang not in few] + taken(known.where(F.col("lang").isin(few)))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        out.setdefault(r.lang, []).append((r.nth, r.piece))
    return {lang: [piece for _, piece in sorted(out[lang])] for lang in sorted(out)}


def dictionaries(texts: dict[str, list[str]], size: int = 1 << 16) -> dict[str, bytes]:
    """Up to `size` bytes of every language, an even share of each text; a language without a byte has none."""
    out = {}
    for lang, some in texts.items():
        share = size // max(1, len(some)) + 1
        content = b"\n".join(x.lower().encode()[:share] for x in some)[:size]
        # The library takes no dictionary under eight bytes.
        content = content * -(-8 // len(content)) if 0 < len(content) < 8 else content
        if content.strip():
            out[lang] = content
    return out


@functools.lru_cache(maxsize=4)
def compressors(content: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard

    out = []
    for _, data in content:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def identified(docs: DataFrame, dicts: dict[str, bytes], level: int = 9, narrow: float = 0.004) -> DataFrame:
    """doc_id, lang_best, score, margin and lang of every row of docs (doc_id, text).

    margin: by how much the smallest size is under the next, as a share of the next; lang: lang_best,
    or `und` where the margin is under `narrow`; score: the weight of lang_best if every byte halves
    a language's weight.
    """
    content = tuple(sorted(dicts.items()))
    names = [k for k, _ in content]

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = compressors(content, level)
        for some in rows(batches, 1 << 23):
            best, score, margin = [], [], []
            for _, text in some:
                if not own or text is None or not any(map(str.isalpha, text)):
                    best.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                raw = text.lower().encode()
                sizes = np.array([len(c.compress(raw)) for c in own], float)
                k = int(sizes.argmin())
                rest = np.delete(sizes, k)
                best.append(names[k])
                score.append(float(1 / np.exp2(-np.minimum(sizes - sizes[k], 60)).sum()))
                margin.append(float((rest.min() - sizes[k]) / rest.min()) if len(rest) else 1.0)
            lang = [b if m >= narrow else "und" for b, m in zip(best, margin, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array(best), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(lang)], ["doc_id", "lang_best", "score", "margin", "lang"])

    return renamed(docs, ["doc_id", "text"]).mapInArrow(make, "doc_id long, lang_best string, score double, margin double, lang string")
