import zlib
from collections import Counter

from quarrygrid.llm import sharding


def check(df, shards):
    got, rows = sharding.shard(df, shards).collect(), df.collect()
    want = Counter((r.doc_id, r.source, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert len(rows) < shards or set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    # Every prefix of the sequence holds each source in proportion, within one row.
    order, n, seen = sorted(got, key=lambda r: (r.shard, r.slot)), Counter(r.source for r in got), Counter()
    for k, r in enumerate(order, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - n[s] * k / len(order)) <= 1 + 0.5 * len(n) for s in n)
    return sorted((r.shard, r.slot, r.doc_id or -1) for r in got)


def test_law_and_mixture(documents):
    assert check(documents, 24) == check(documents.repartition(7), 24)


def test_hot_source(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 12}") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 24)


def test_one_doc_id_for_all(spark):
    for rows in ([(None, f"text {i % 700}", "a") for i in range(2000)], [(7, "same", "ab"[i % 2]) for i in range(2000)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        check(df, 24)


def test_equal_rows_are_told_apart(spark):
    from pyspark.sql import functions as F

    from quarrygrid.llm.common import saved, told_apart

    df = saved(spark.range(5000).select((F.col("id") % 3).alias("k"), F.monotonically_increasing_id().alias("number")), "test-rows")
    got = told_apart(df, ["k"], "number", "nth").collect()
    assert all(sorted(r.nth for r in got if r.k == k) == list(range(sum(r.k == k for r in got))) for k in range(3))


def test_odd(odd, none):
    check(odd, 5)
    check(odd, 24)
    assert sharding.shard(none).count() == 0


def test_files(spark, documents, odd, tmp_path):
    for k, df in enumerate((documents, odd)):
        sharding.write_shards(df, str(tmp_path / str(k)), 4)
        back = spark.read.parquet(str(tmp_path / str(k)))
        assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == sorted(map(str, df.select("doc_id", "text", "source").collect()))
