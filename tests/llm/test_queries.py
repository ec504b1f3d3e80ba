"""The registered queries over the whole tables of the smallest scale."""

import pytest

from quarrygrid.llm import queries

COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op2": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "fingerprint", "component_id"],
    "op8": ["doc_id", "size", "source_size", "target", "taken"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    table = "embeddings" if name.startswith("op1_") else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    assert df.columns == COLUMNS[name.split("_")[0]]
    assert df.select(key).distinct().count() == spark.read.parquet(f"{small}/{table}.parquet").count()


def test_fingerprints_are_hexadecimal(spark, small):
    assert queries.op7_simhash_anchors(spark, small).where("not fingerprint rlike '^[0-9a-f]{16}$'").isEmpty()
