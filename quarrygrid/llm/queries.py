"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ego_join, langid, mixing, packing, quality, sharding, simhash, suffix_dedup, token_frames, toxicity
from .common import table, tokenizer_path


def _fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_frames.token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.digest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_pack_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"), _fold(3) != 1))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = langid.dictionaries(langid.sample(docs, _fold(4) != 2))
    out = langid.identified(docs, dicts)
    return out.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score")


QUERIES = {f.__name__: f for f in (op1_ego_join, op2_token_frames, op3_shard_interleave, op4_suffix_columns, op5_pack_squares, op6_toxicity_subwords, op7_simhash_anchors, op8_mix_entropy, op9_quality_votes, op10_language_zstd)}

#: DuckDB SQL of what SQL can express; the others need tokenizers, XXH64, CRC-32, compressors or fitted models.
SQL: dict[str, str] = {
    "op1_ego_join": """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op4_suffix_columns": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM docs WHERE len(h) >= 200),
windows AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w FROM places),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows)
  WHERE k > 1
), parted AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again)
), runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM parted GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS kept
  FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) JOIN docs USING (doc_id)
), cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)""",
}
