"""The training-data pipeline over `documents`; its stages are operators of quarrygrid.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet in the shared folder and read again.  All stages but the last return the
columns of documents; an empty table gives no rows in any of them, and other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.llm import mixing, packing, quality, similar, suffix_dedup
from quarrygrid.llm.common import saved, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' label model takes for good; the others go.

    Null, empty and short texts go.  Repeated rows and doc_ids, null ones too, are judged row by row.
    """
    return quality.kept_rows(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word Jaccard similarity of 0.8 the one with the smallest doc_id.

    Texts meet at SimHash anchors of their 5-word shingles; the exact similarity decides.
    Null, empty and blank texts are one group; of a group's rows with one doc_id the one whose text has the
    smallest hash stays, of equal rows any; a null doc_id stays only where its group has no other.
    """
    return similar.representatives(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; a document stays even if nothing of it is left.

    Null texts stay null.  Null doc_ids come first, equal ones are ordered by a hash of the text.
    """
    out = suffix_dedup.deduplicated(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    Null is a source of its own.  Texts without words have no size: how often they come changes no total.  Equal
    rows have copies of their own.
    """
    return mixing.mixed_rows(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the training sequences.

    A null or empty text is one piece, the end id; rows with equal doc_id are packed each on its own.
    """
    out = packing.packed(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: Label models, fingerprints, suffix sorting and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
