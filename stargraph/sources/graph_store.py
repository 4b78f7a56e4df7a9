"""Graph table storage (S7) and label / relationship scans.

Products are partitioned by category (a category filter prunes whole folders); every category is written by one
group of tasks, not by every task.  CO_PURCHASED is stored once, range-partitioned and sorted by its first endpoint,
with Parquet bloom filters on both endpoints: an anchored lookup reads the row groups whose range holds the id as first
endpoint, and those whose filter may hold it as second.  Tables are read with the schema that was written next to them,
so a category that looks like a number stays text.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import ReviewGraph
from ..session import materialize

# label / relationship type → (table folder, partition columns)
LAYOUT = {
    "Product": ("products", ["category"]),
    "Reviewer": ("reviewers", []),
    "Category": ("categories", []),
    "REVIEWED": ("reviewed", []),
    "CO_PURCHASED": ("co_purchased", []),
    "BELONGS_TO": ("belongs_to", []),
    "ACTIVE_IN": ("active_in", []),
}
REVIEWS = "reviews"


def _frames(g: ReviewGraph) -> dict[str, DataFrame]:
    return {
        "Product": g.products, "Reviewer": g.reviewers, "Category": g.categories, "REVIEWED": g.reviewed,
        "CO_PURCHASED": g.co_purchased, "BELONGS_TO": g.belongs_to, "ACTIVE_IN": g.active_in,
    }


def _write(
    df: DataFrame, base: str, folder: str, mode: str, parts: list[str] = (), ranged: str | None = None, blooms: list[str] = (),
) -> str:
    path = f"{base.rstrip('/')}/{folder}"
    out = df.repartitionByRange(ranged).sortWithinPartitions(ranged) if ranged else df
    if parts:
        out = out.repartition(*parts).sortWithinPartitions(*parts)
    writer = out.write.mode(mode)
    for column in blooms:
        # sized by the distinct values of the row group; a fixed size would be too large for small ones
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}_schema")
    return path


def _read(spark: SparkSession, base: str, folder: str) -> DataFrame:
    path = f"{base.rstrip('/')}/{folder}"
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}_schema").first()[0]))
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_graph_tables(g: ReviewGraph, base: str, mode: str = "errorifexists") -> dict[str, str]:
    """One parquet table per node label and relationship type under ``base``; returns their paths.

    Product nodes are written first and the tables that need them (BELONGS_TO, the categories on
    CO_PURCHASED, the score on REVIEWED) are built from the written copy, so the per-product aggregation over
    all reviews runs once instead of once per table.  The copy is read with the written schema: partition
    type inference must not turn a category name that looks like a number into a number.
    """
    folder, parts = LAYOUT["Product"]
    paths = {"Product": _write(g.products, base, folder, mode, parts)}
    if not g.is_given("products"):
        g = g.with_tables(products=_read(g.products.sparkSession, base, folder))
    if not g.is_given("co_purchased"):
        # a range write samples its input first: from a written copy, so the pairs are counted once
        g = g.with_tables(co_purchased=materialize(g.co_purchased, "co-purchased"))
    for name, df in _frames(g).items():
        if name == "CO_PURCHASED":
            paths[name] = _write(df, base, LAYOUT[name][0], mode, ranged="src", blooms=["src", "dst"])
        elif name != "Product":
            paths[name] = _write(df, base, LAYOUT[name][0], mode)
    _write(g.reviews, base, REVIEWS, mode)
    return paths


def scan(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The stored table of one node label or relationship type."""
    return _read(spark, base, LAYOUT[name][0])


def scan_nodes(spark: SparkSession, base: str, label: str) -> DataFrame:
    return scan(spark, base, label)


def scan_edges(spark: SparkSession, base: str, rel_type: str) -> DataFrame:
    return scan(spark, base, rel_type)


def load_graph(spark: SparkSession, base: str) -> ReviewGraph:
    """A ``ReviewGraph`` over stored tables."""
    return ReviewGraph(
        reviews=_read(spark, base, REVIEWS),
        products=scan(spark, base, "Product"),
        reviewers=scan(spark, base, "Reviewer"),
        categories=scan(spark, base, "Category"),
        belongs_to=scan(spark, base, "BELONGS_TO"),
        co_purchased=scan(spark, base, "CO_PURCHASED"),
        reviewed=scan(spark, base, "REVIEWED"),
        active_in=scan(spark, base, "ACTIVE_IN"),
    )
