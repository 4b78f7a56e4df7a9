"""The corpus pipeline over ``documents``.

Five stages, each a function ``(spark, docs, sf_dir) -> DataFrame`` that is written as Parquet and read again as the
next one's documents:

quality           documents that the quality classifier rejects go
line_dedup        repeated lines go (``n_chars`` follows the text)
near_duplicates   of each SimHash group the document with the smallest doc_id stays
decontamination   documents that hold a benchmark window go
mixing            what is left is mixed to the source weights and sorted by training position

All but the last return the columns of ``documents``; the last adds size, source_size, target, taken and position.
Null texts count as empty, rows with a null doc_id are documents like any other, empty tables pass through.  Of rows with
equal doc_id and text that differ elsewhere the one with the smallest digest of its other columns stays.  Extra columns
are kept, whatever their names (but for the five that the last stage adds and names that begin with ``_ld_``, ``_sh_`` or
``_mx_``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargraph.llm import decontaminate, line_dedup, mixing, quality, simhash
from stargraph.llm.common import materialize, table, text_or_empty, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted to be of low quality."""
    stats = unused("_stats", docs.columns)  # written once, for learning and for the scores
    known = materialize(docs.withColumn(stats, quality.features(F.col("text"))), "pipeline-statistics")
    rows = quality.labelled(known.select("doc_id", F.col(stats).alias("stats")), table(spark, sf_dir, "labels"))
    model = quality.fit(materialize(rows, "pipeline-labelled"))
    return known.filter(quality.score(F.col(stats), model) >= quality.THRESHOLD).drop(stats)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its repeated lines."""
    cleaned = line_dedup.dedup(docs).drop("_ld_lines", "_ld_dropped")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length(text_or_empty(F.col("text"))).cast("long"))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in training order."""
    return mixing.mix(docs.withColumn("size", mixing.words(F.col("text"))))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier's score and XXH64 are not expressible in SQL; tests run a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
