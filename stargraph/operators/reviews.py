"""The canonical review table and the row-level operators on it.

* ``keep_latest`` / ``merge_upsert`` (E1): idempotent keyed load – the latest load wins, ties broken by a
  fixed column order.  Written as a grouped ``max``/``min`` of a struct instead of a window: the aggregate is
  partially combined on the map side, so a key holding a third of all rows is pre-reduced per task before the
  shuffle instead of landing whole in one window partition.
* ``reviews_from_tables``: the §1.4 mapping of the driver tables onto reviews.
* ``flag_bots`` / ``drop_bots`` (P9, J8), ``budget_subset`` (P10), ``enrich_titles`` (J7),
  ``keep_multibuyers`` (J9).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW_COLUMNS = ("review_id", "reviewer_id", "product_id", "title", "category", "stars", "ts")


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (ascending, nulls first).

    ``keys + order`` should be unique; otherwise one of the equal rows is kept (their content is equal on
    ``order`` but may differ elsewhere).  Plan: partial SortAggregate → shuffle by key → final aggregate.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("__first"))
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in (*order, *rest)])
        .select(*df.columns)
    )


def keep_latest(df: DataFrame, keys: Sequence[str], load_col: str, tie: Sequence[str]) -> DataFrame:
    """One row per key: highest ``load_col``; within a load the smallest by ``tie``; a null load is the oldest.

    Equivalent to ``row_number() over (partition by keys order by load desc nulls last, tie asc) = 1``.
    """
    neg_load = F.coalesce(-F.col(load_col).cast("bigint"), F.lit((1 << 63) - 1))
    return keep_first(df.withColumn("__neg_load", neg_load), keys, ["__neg_load", *tie]).drop("__neg_load")


def merge_upsert(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    tie: Sequence[str],
    load_col: str = "load_no",
) -> DataFrame:
    """Existing ∪ incoming, latest load wins per key.  ``merge(merge(x, d), d) == merge(x, d)``.

    Both inputs carry ``load_col``; rows of ``incoming`` without it are given ``max(existing load) + 1``
    by the caller (see ``streaming.reload``).
    """
    rows = incoming if existing is None else existing.unionByName(incoming)
    return keep_latest(rows, keys, load_col, tie)


def review_key(orderkey: Column, linenumber: Column) -> Column:
    return orderkey * F.lit(10) + linenumber


def stars_from_quantity(q: Column) -> Column:
    """§1.4: near-uniform 1..5 from the quantity."""
    return (F.floor(q - F.lit(1)).cast("int") % F.lit(5) + F.lit(1)).cast("int")


def review_rows(lineitem: DataFrame) -> DataFrame:
    """Raw review deliveries: one row per line item, keyed by ``(l_orderkey, l_linenumber)`` (not unique)."""
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")


def reviews_from_tables(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Canonical ``reviews``: review_id, reviewer_id, product_id, title, category, stars, ts.

    The review key is deduplicated first (keep the first row by ``(l_partkey, l_suppkey, l_shipdate)``),
    then the reviewer comes from ``orders`` and title / category from ``part``.  Both are plain equi-joins:
    Catalyst picks sort-merge or (AQE, by measured size) broadcast; AQE splits a skewed order key.
    """
    first = keep_first(review_rows(lineitem), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])
    o = orders.select(F.col("o_orderkey"), F.col("o_custkey").alias("reviewer_id"))
    p = part.select(F.col("p_partkey"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return (
        first.join(o, first.l_orderkey == o.o_orderkey)
        .join(p, first.l_partkey == p.p_partkey)
        .select(
            review_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("review_id"),
            "reviewer_id",
            F.col("l_partkey").alias("product_id"),
            "title",
            "category",
            stars_from_quantity(F.col("l_quantity")).alias("stars"),
            F.col("l_shipdate").alias("ts"),
        )
    )


# ── P9 / J8: bot reviewers ───────────────────────────────────────────────────────────────────────────────
def flag_bots(reviews: DataFrame, min_reviews: int = 500, min_ratio: float = 0.95) -> DataFrame:
    """Reviewers with more than ``min_reviews`` reviews whose modal star value covers more than
    ``min_ratio`` of them.  Two partially-combined aggregates; no per-reviewer collection.

    Output: reviewer_id, review_count, modal_count, ratio.
    """
    per_star = reviews.groupBy("reviewer_id", "stars").agg(F.count(F.lit(1)).alias("n"))
    per_reviewer = per_star.groupBy("reviewer_id").agg(
        F.sum("n").alias("review_count"), F.max("n").alias("modal_count")
    )
    return (
        per_reviewer.withColumn("ratio", F.col("modal_count") / F.col("review_count"))
        .filter((F.col("review_count") > F.lit(min_reviews)) & (F.col("ratio") > F.lit(min_ratio)))
    )


def drop_bots(reviews: DataFrame, bots: DataFrame) -> DataFrame:
    """The reviews whose reviewer is not flagged (left anti join on the reviewer key)."""
    return reviews.join(bots.select("reviewer_id"), "reviewer_id", "left_anti").select(*reviews.columns)


# ── P10: reduce to a size budget ─────────────────────────────────────────────────────────────────────────
def budget_threshold(reviews: DataFrame, budget: int | None = None, budget_fraction: float | None = None) -> DataFrame:
    """Smallest per-reviewer review count ``k`` such that reviewers with ≥ k reviews hold ≤ budget reviews.

    Per-reviewer counts → histogram by count (one row per distinct count value, tiny) → suffix sum over the
    histogram (the only unpartitioned window, and it runs over the aggregated histogram) → 1-row result
    ``(k, kept_reviews, budget)``.  ``k`` is null when not even the busiest reviewers fit.
    """
    counts = reviews.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("reviewers"), F.sum("n").alias("rows"))
    if budget is not None:
        limit = F.lit(int(budget)).cast("bigint")
    elif budget_fraction is not None:
        limit = F.floor(F.sum("rows").over(Window.partitionBy()) * F.lit(float(budget_fraction))).cast("bigint")
    else:
        raise ValueError("give budget or budget_fraction")
    suffix = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.select("n", F.sum("rows").over(suffix).alias("kept"), limit.alias("budget"))
    return ranked.agg(
        F.min(F.when(F.col("kept") <= F.col("budget"), F.col("n"))).alias("k"),
        F.max(F.when(F.col("kept") <= F.col("budget"), F.col("kept"))).alias("kept_reviews"),
        F.first("budget").alias("budget"),
    )


def budget_subset(reviews: DataFrame, budget: int | None = None, budget_fraction: float | None = None) -> DataFrame:
    """P10: keep the reviews of the most active reviewers within the budget (biased to multi-buyers)."""
    k = budget_threshold(reviews, budget, budget_fraction).select("k").scalar()  # scalar subquery
    counts = reviews.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("__n"))
    keep = counts.filter(F.col("__n") >= k).select("reviewer_id")
    return reviews.join(keep, "reviewer_id", "left_semi").select(*reviews.columns)


# ── J7 / J9 ──────────────────────────────────────────────────────────────────────────────────────────────
def enrich_titles(reviews: DataFrame, meta: DataFrame, id_col: str = "product_id", title_col: str = "title") -> DataFrame:
    """Attach ``product_title`` from a metadata table (made unique per id first: smallest title)."""
    m = meta.groupBy(id_col).agg(F.min(title_col).alias("product_title"))
    return reviews.join(m, id_col, "left")


def keep_multibuyers(reviews: DataFrame) -> DataFrame:
    """Reviews of reviewers with more than one distinct product."""
    multi = (
        reviews.select("reviewer_id", "product_id").distinct()
        .groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).select("reviewer_id")
    )
    return reviews.join(multi, "reviewer_id", "left_semi").select(*reviews.columns)
