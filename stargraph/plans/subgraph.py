"""Subgraph assembly (G1–G3): query rows → a deduplicated node table and edge table.

The input is the ≤ k rows of one intent query (``intents.subgraph_rows``) with a ``rank`` column, or the rows of many
queries told apart by key columns (``keys``: they stay on nodes and edges, and nothing is merged across them).  Node
attributes are looked up in the product table (one row per id, so no "first seen" ambiguity); co-purchase
edges keep one row per unordered pair – the best-ranked row, with its direction.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    CATEGORY_LABELS, category_node_id, edge_width, label_lookup, short_title, tooltip,
)

# Fixed values of the reference: node kinds, relationship names, the category tooltip prefix.
PRODUCT, CATEGORY = "Product", "Category"
BELONGS_TO, CO_PURCHASED = "BELONGS_TO", "CO_PURCHASED"
CATEGORY_TOOLTIP_PREFIX = "📂 Categoría: "
WEIGHT_TITLE_PREFIX = "CO_PURCHASED\nPeso: "


def _ends(rows: DataFrame) -> list[tuple[str, str]]:
    """(product id column, category column) for each end present in the rows."""
    ends = [("pid", "category")]
    if "pid2" in rows.columns:
        ends.append(("pid2", "category2" if "category2" in rows.columns else None))
    return ends


def subgraph_nodes(rows: DataFrame, products: DataFrame, labels=CATEGORY_LABELS, keys: Sequence[str] = ()) -> DataFrame:
    """G1: product nodes of both ends ∪ category nodes, one per id.

    Output: keys, node_id (string), kind, label, tooltip.
    """
    ids = None
    cats = None
    for pid, cat in _ends(rows):
        i = rows.filter(F.col(pid).isNotNull()).select(*keys, F.col(pid).alias("product_id"))
        ids = i if ids is None else ids.unionByName(i)
        if cat is not None:
            c = rows.filter(F.col(cat).isNotNull() & (F.col(cat) != "")).select(*keys, F.col(cat).alias("name"))
            cats = c if cats is None else cats.unionByName(c)
    kept = [F.col(f"__keys.{k}").alias(k) for k in keys]
    packed = F.struct(*keys).alias("__keys") if keys else F.lit(None).alias("__keys")  # product columns may clash
    prod = ids.distinct().select("product_id", packed).join(products, "product_id", "left").select(
        *kept,
        F.col("product_id").cast("string").alias("node_id"),
        F.lit(PRODUCT).alias("kind"),
        short_title(F.col("title"), F.col("product_id")).alias("label"),
        tooltip("title", "product_id", "category", "avg_stars", "bayesian_score", "review_count").alias("tooltip"),
    )
    cat_nodes = cats.distinct().select(
        *keys,
        category_node_id(F.col("name")).alias("node_id"),
        F.lit(CATEGORY).alias("kind"),
        label_lookup(F.col("name"), labels).alias("label"),
        F.concat(F.lit(CATEGORY_TOOLTIP_PREFIX), F.col("name")).alias("tooltip"),
    )
    return prod.unionByName(cat_nodes)


def subgraph_edges(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """BELONGS_TO edges (one per product/category pair) ∪ CO_PURCHASED edges (one per unordered pair,
    the best-ranked row wins and keeps its direction).  Output: keys, src, dst, type, width, title."""
    bt = None
    for pid, cat in _ends(rows):
        if cat is None:
            continue
        e = rows.filter(F.col(pid).isNotNull() & F.col(cat).isNotNull() & (F.col(cat) != "")).select(
            *keys, F.col(pid).cast("string").alias("src"), category_node_id(F.col(cat)).alias("dst")
        )
        bt = e if bt is None else bt.unionByName(e)
    belongs = bt.distinct().select(
        *keys, "src", "dst", F.lit(BELONGS_TO).alias("type"), F.lit(1).cast("bigint").alias("width"),
        F.lit(BELONGS_TO).alias("title"),
    )
    if "pid2" not in rows.columns:
        return belongs
    pairs = rows.filter(F.col("pid").isNotNull() & F.col("pid2").isNotNull())
    w = Window.partitionBy(*keys, F.least("pid", "pid2"), F.greatest("pid", "pid2")).orderBy("rank")
    shown = F.when(F.coalesce(F.col("weight"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("weight"))
    co = (
        pairs.withColumn("__first", F.row_number().over(w))
        .filter(F.col("__first") == 1)
        .select(
            *keys, F.col("pid").cast("string").alias("src"), F.col("pid2").cast("string").alias("dst"),
            F.lit(CO_PURCHASED).alias("type"), edge_width(F.col("weight")).alias("width"),
            F.concat(F.lit(WEIGHT_TITLE_PREFIX), shown.cast("string")).alias("title"),
        )
    )
    return belongs.unionByName(co)


def subgraph_summary(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Node and relationship counts of one subgraph (1 row), or of each key's."""
    if keys:
        counted = nodes.select(*keys, F.lit(1).alias("n"), F.lit(0).alias("r")).unionByName(
            edges.select(*keys, F.lit(0).alias("n"), F.lit(1).alias("r")))
        return counted.groupBy(*keys).agg(F.sum("n").alias("nodes"), F.sum("r").alias("relationships"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).select(
        "nodes", edges.agg(F.count(F.lit(1))).scalar().alias("relationships")
    )
