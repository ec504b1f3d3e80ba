import zlib

from pyspark.sql import functions as F

from quarrygrid.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_zstd(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.96


def test_only_training_rows_are_learned(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoiled = documents.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    assert langid.sample(documents, ~held) == langid.sample(spoiled, ~held)


def test_odd(odd, none):
    texts = langid.sample(odd, F.lit(True))
    assert set(texts) == {"de", "en", "ja"}
    dicts = langid.dictionaries(texts)
    got = langid.identified(odd, dicts).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3].lang_best == by[4].lang_best == by[5].lang_best == "und" and by[3].score == 0
    assert by[7].lang_best == "de" and by[6].lang_best == "en"
    assert {r.lang_best for r in langid.identified(odd, {}).collect()} == {"und"}
    assert langid.identified(none, dicts).count() == 0 and langid.sample(none, F.lit(True)) == {}


def test_narrow_margins_are_rejected(spark):
    dicts = {"a": b"alpha beta gamma delta " * 50, "b": b"eins zwei drei vier fuenf " * 50}
    df = spark.createDataFrame([(1, "alpha beta gamma delta alpha gamma beta"), (2, "qqq www"), (3, "eins zwei drei vier fuenf eins drei")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identified(df, dicts).collect()}
    assert got[1].lang == "a" and got[3].lang == "b" and got[2].lang == "und" and got[2].lang_best in dicts
    assert got[1].margin > got[2].margin


def test_bounds_of_training_are_parameters(documents):
    short = langid.sample(documents, F.lit(True), per_language=3, each=10)
    assert all(len(some) <= 3 and all(len(x) <= 10 for x in some) for some in short.values())


def test_same_as_plain_zstandard(spark, documents):
    """Every document's language by the library alone, a fresh compressor each time."""
    import zstandard

    dicts = langid.dictionaries(langid.sample(documents, F.lit(True)))
    got = {r.doc_id: r.lang_best for r in langid.identified(documents, dicts).collect()}
    for r in documents.collect():
        sizes = []
        for lang in sorted(dicts):
            own = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            frame = zstandard.ZstdCompressor(level=9, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(r.text.lower().encode())
            sizes.append((len(frame), lang))
        assert got[r.doc_id] == (min(sizes)[1] if any(c.isalpha() for c in r.text) else "und")


def test_rows_without_an_id_train(spark):
    df = spark.createDataFrame([(None, "ein haus am see " * 300, "de"), (None, "ja", "xx"), (1, "a house by the lake", "en")], "doc_id long, text string, lang string")
    texts = langid.sample(df, F.lit(True))
    assert set(texts) == set(langid.dictionaries(texts)) == {"de", "xx", "en"} and len(texts["de"][0]) == 2048
