"""Aggregations over reviews and graph tables.

Counts are ``bigint``; averages are an integer sum divided once by a count (never an average of averages).
Every grouped aggregate here is partially combined before its shuffle, so a hot key costs one row per task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one():
    return F.lit(1)


def _stats(reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        reviews.groupBy(*keys)
        .agg(F.count(_one()).alias("review_count"), F.sum(F.col("stars").cast("bigint")).alias("sum_stars"))
        .withColumn("avg_stars", F.col("sum_stars") / F.col("review_count"))
    )


def product_stats(reviews: DataFrame) -> DataFrame:
    """A1: product_id, review_count, sum_stars, avg_stars."""
    return _stats(reviews, ["product_id"])


def reviewer_stats(reviews: DataFrame) -> DataFrame:
    """A2: reviewer_id, review_count, sum_stars, avg_stars."""
    return _stats(reviews, ["reviewer_id"])


def global_mean(stats: DataFrame) -> DataFrame:
    """Mean star value of all reviews as a 1-row frame, from per-key sums (exact integer sums)."""
    return stats.agg((F.sum("sum_stars") / F.sum("review_count")).alias("mean_stars"))


def review_mean(reviews: DataFrame) -> Column:
    """Mean star value of all reviews as a scalar subquery over one partially combined global aggregate."""
    return reviews.agg(
        (F.sum(F.col("stars").cast("bigint")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mean_stars")
    ).scalar()


def bayesian_score(stats: DataFrame, prior_weight: float = 10.0, mean: float | Column | None = None) -> DataFrame:
    """A3: ``(C·mean + Σstars) / (C + n)`` with ``C = prior_weight``; mean = global mean unless given (a value
    or a scalar column such as ``review_mean``).

    The global mean is a scalar subquery (computed once, inlined as a value).  Fixed values of the reference:
    C = 10, mean = 4.32 on its data.
    """
    c = F.lit(float(prior_weight))
    if isinstance(mean, Column):
        m = mean
    else:
        m = global_mean(stats).scalar() if mean is None else F.lit(float(mean))
    return stats.withColumn("bayesian_score", (c * m + F.col("sum_stars")) / (c + F.col("review_count")))


def active_in(reviews: DataFrame, min_reviews: int = 1) -> DataFrame:
    """A4: per (reviewer, category) review_count and avg_stars, keeping pairs with ≥ ``min_reviews``.

    Reviews without a category (null or empty) belong to no Category node and make no edge.
    """
    return (
        _stats(reviews.filter(F.col("category") != ""), ["reviewer_id", "category"])
        .filter(F.col("review_count") >= F.lit(min_reviews))
        .select("reviewer_id", "category", "review_count", "avg_stars")
    )


def items_per_buyer(df: DataFrame, buyer: str, item: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Distinct items per buyer (``countDistinct`` as distinct + count, both partially combined)."""
    keys = [*extra_keys, buyer]
    return df.select(*keys, item).distinct().groupBy(*keys).agg(F.count(_one()).alias("n_items"))


def multi_buyer_stats(df: DataFrame, buyer: str = "reviewer_id", item: str = "product_id") -> DataFrame:
    """A5: buyers with more than one distinct item: how many, average and maximum items (over multi-buyers)."""
    per = items_per_buyer(df, buyer, item).filter(F.col("n_items") > 1)
    return per.agg(
        F.count(_one()).alias("multi_buyers"),
        (F.sum("n_items") / F.count(_one())).alias("avg_items"),
        F.max("n_items").alias("max_items"),
    )


def multi_buyer_share(df: DataFrame, dataset: str, buyer: str, item: str) -> DataFrame:
    """Per dataset, buyers, multi-buyers and their percentage.

    A buyer has several items if the smallest and the largest differ, or if some but not all are null (null is an item
    of its own, as in ``items_per_buyer``): one aggregate per buyer, with no set of its items.
    """
    per = df.groupBy(dataset, buyer).agg(
        F.min(item).alias("lo"), F.max(item).alias("hi"), F.count(item).alias("known"), F.count(_one()).alias("n")
    )
    several = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) | F.col("known").between(1, F.col("n") - 1)
    return per.groupBy(dataset).agg(
        F.count(_one()).alias("buyers"),
        F.count_if(several).alias("multi_buyers"),
        (F.count_if(several) * F.lit(100.0) / F.count(_one())).alias("multi_buyer_pct"),
    )


def category_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per category."""
    return reviews.groupBy("category").agg(F.count(_one()).alias("reviews"))


def category_affinity_directed(edges_with_cats: DataFrame) -> DataFrame:
    """Per ordered category pair of cross-category edges: edge count and total weight.

    Input columns: src_category, dst_category, weight.
    """
    return (
        edges_with_cats.filter(F.col("src_category") != F.col("dst_category"))
        .groupBy("src_category", "dst_category")
        .agg(F.count(_one()).alias("edges"), F.sum("weight").alias("total_weight"))
    )


def category_affinity_undirected(edges_with_cats: DataFrame) -> DataFrame:
    """The same over unordered pairs (``least``/``greatest`` of the two names)."""
    return (
        edges_with_cats.filter(F.col("src_category") != F.col("dst_category"))
        .groupBy(
            F.least("src_category", "dst_category").alias("category_a"),
            F.greatest("src_category", "dst_category").alias("category_b"),
        )
        .agg(F.count(_one()).alias("edges"), F.sum("weight").alias("total_weight"))
    )


def table_counts(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``kind, name, n``: rows of each table; ``parts`` maps a name to ``(kind, frame)``."""
    frames = [
        df.agg(F.count(_one()).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
        for name, (kind, df) in parts.items()
    ]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u


def with_totals(counts: DataFrame) -> DataFrame:
    """``kind, name, n`` with a total per kind and the grand total (``rollup``)."""
    return (
        counts.rollup("kind", "name").agg(F.sum("n").alias("n"))
        .select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("name", F.lit("total")).alias("name"), "n")
    )


def graph_counts(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """A10: rows per node label / relationship type plus per-kind and grand totals.

    ``parts`` maps a name to ``(kind, frame)`` with kind ``node`` or ``relationship``.  ``graph.count_graph`` gives the
    same rows for a graph whose tables are still to be built, in fewer passes.
    """
    return with_totals(table_counts(parts))


def title_coverage(df: DataFrame, title_col: str = "product_title") -> DataFrame:
    """Percentage of rows that carry a title."""
    return df.agg(
        F.count(_one()).alias("rows"),
        F.count(title_col).alias("with_title"),
        (F.count(title_col) * F.lit(100.0) / F.count(_one())).alias("title_pct"),
    )


def copurchase_degree(edges: DataFrame) -> DataFrame:
    """Neighbours and total weight per product over both directions of each stored edge (a self-loop counts once).

    Each end is counted on its own, and the two small tables are added: no doubled edge table is shuffled.
    """
    def counted(end: str, counts) -> DataFrame:
        return edges.groupBy(F.col(end).alias("product_id")).agg(
            F.count(F.when(counts, _one())).alias("n"), F.sum(F.when(counts, F.col("weight"))).alias("w")
        )

    other = F.col("src") != F.col("dst")  # not a filter: both ends then read one shared exchange
    ends = counted("src", F.lit(True)).unionByName(counted("dst", other))
    return ends.groupBy("product_id").agg(F.sum("n").alias("degree"), F.sum("w").alias("total_weight"))


def weight_distribution(edges: DataFrame) -> DataFrame:
    """Edges per weight value, with the maximum weight on every row."""
    per = edges.groupBy("weight").agg(F.count(_one()).alias("edges"))
    return per.withColumn("max_weight", edges.agg(F.max("weight")).scalar())


def distinct_categories(reviews: DataFrame) -> DataFrame:
    """The category node set (non-empty names)."""
    return reviews.select(F.col("category").alias("name")).filter(
        F.col("name").isNotNull() & (F.col("name") != "")
    ).distinct()


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (must be empty for a node key)."""
    return df.groupBy(*keys).agg(F.count(_one()).alias("copies")).filter(F.col("copies") > 1)
