"""The registered queries of the dealt operators: production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargraph.llm import (
    decontaminate, filter_audit, fingerprint, infill, langid, line_dedup, mixing, oracles, packing, pii, quality, secrets,
    simhash, url_filter,
)
from stargraph.llm.common import documents, materialize, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op7_mixing": oracles.MIXING,
    "op10_url_filter": oracles.URL_FILTER,
    "op12_infill": oracles.INFILL,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stats = materialize(docs.select("doc_id", quality.features(docs["text"]).alias("stats")), "quality-stats")
    model = quality.fit(materialize(quality.labelled(stats, table(spark, sf_dir, "labels")), "quality-labelled"))
    return stats.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        quality.score(F.col("stats"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    part = remainder(F.col("doc_id"), 4)
    model = langid.Model(langid.learn_samples(docs.filter(part != 2)))
    return langid.predict(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = materialize(docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size")), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "position")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(secrets.candidates(documents(spark, sf_dir)), "secret-candidates")
    learn = remainder(F.col("doc_id"), 5) != 0
    return secrets.scan(secrets.weak_labels(found), learn).select(
        "doc_id",
        "nth",
        F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        "secret",
    )


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(documents(spark, sf_dir))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    verdicts = url_filter.evaluate(url_filter.derived_captures(pages), url_filter.derived_entries(pages))
    return verdicts.select("page_id", "day", "host", "verdict", "matched", "since")


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(documents(spark, sf_dir))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
