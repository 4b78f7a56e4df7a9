"""Co-purchase pair counting (E6 / E7) that survives a reviewer holding a third of all rows.

weight(a, b) = number of distinct reviewers who reviewed both a and b.  The distinct (reviewer, product) incidence
is written once; three facts are then measured on it (small aggregates, one row each): the pairs that the self-join
will make, the largest number of products of one reviewer, and how many rows have too rare a product.

* No reviewer above ``block_size`` products: the plain self-join on the reviewer, its one exchange shared by both
  sides.  Its partitions are sized by the pairs it makes (``PAIRS_PER_TASK``), not by its small input.
* Otherwise every reviewer's products are split into ``nb = ceil(deg / block_size)`` hash blocks, and each
  *unordered block pair* (i ≤ j) of one reviewer is its own join key ``(reviewer, i, j)``: a row in block ``b`` goes
  left to keys (b, j) for j ≥ b and right to keys (i, b) for i ≤ b (nb + 1 copies, i.e. ``deg² / block_size`` rows
  for a reviewer – small next to its deg²/2 pairs); for i = j only ``a < b`` is kept.  Every unordered pair of a
  reviewer is produced exactly once, by exactly one task.
* With ``min_weight ≥ 2`` an item reviewed by fewer than ``min_weight`` reviewers is in no kept pair.  Such rows are
  dropped first where that pays for its shuffle (``PREFILTER_SHARE`` of the rows); the result is the same.

* Above ``LISTED_PAIRS`` pairs, rows of single pairs would make most of the shuffle: there a reviewer's products are one
  sorted list, each product sends the rest of the list after it as an array, and the arrays are shuffled by their first
  product and counted there.  A product with more pairs than a task takes is divided by a hash of the other product, a
  reviewer above the block size into pairs of blocks as above.

Below that, pair counts are partially combined before the shuffle by pair.  Nothing is capped or sampled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_BLOCK = 1024
PAIRS_PER_TASK = 2_000_000
LISTED_PAIRS = 20_000_000
LISTS_SHARE = 8  # the lists of products take fewer tasks than the pairs made from them
PREFILTER_SHARE = 0.3


def incidence(reviews: DataFrame, group: str = "reviewer_id", item: str = "product_id") -> DataFrame:
    """Distinct (group, item) pairs."""
    return reviews.select(F.col(group).alias("g"), F.col(item).alias("item")).filter(
        F.col("g").isNotNull() & F.col("item").isNotNull()
    ).distinct()


def pair_counts(
    inc: DataFrame, min_weight: int = 2, block_size: int = DEFAULT_BLOCK, listed_pairs: int = LISTED_PAIRS
) -> DataFrame:
    """(src, dst, weight) with src < dst and weight ≥ min_weight, from a distinct (g, item) incidence.

    ``inc`` is read several times: pass a written table.
    """
    if block_size < 1:
        raise ValueError("block_size must be positive")
    if min_weight >= 2:
        per_item = inc.groupBy("item").agg(F.count(F.lit(1)).alias("__r"))
        rare = F.coalesce(F.sum(F.when(F.col("__r") < F.lit(min_weight), F.col("__r"))), F.lit(0))
        if per_item.select(rare >= F.sum("__r") * F.lit(PREFILTER_SHARE)).first()[0]:
            keep = per_item.filter(F.col("__r") >= F.lit(min_weight)).select("item")
            inc = materialize(inc.join(keep, "item", "left_semi").select("g", "item"), "incidence-kept")
    degree = inc.groupBy("g").agg(F.count(F.lit(1)).alias("deg"))
    made, largest = degree.agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2), F.max("deg")).first()
    n = max(1, -(-int(made or 0) // PAIRS_PER_TASK), inc.sparkSession.sparkContext.defaultParallelism)
    if (made or 0) > listed_pairs:
        return _listed_pairs(inc, degree, largest, block_size, n).filter(F.col("weight") >= F.lit(min_weight))
    if (largest or 0) <= block_size:
        dealt = inc.repartition(n, "g")
        left, right = dealt.withColumnRenamed("item", "src"), dealt.withColumnRenamed("item", "dst")
        pairs = left.join(right, (left.g == right.g) & (F.col("src") < F.col("dst"))).select("src", "dst")
    else:
        pairs = _block_pairs(inc, degree, block_size, n)
    return (
        pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
        .filter(F.col("weight") >= F.lit(min_weight))
    )


def _block_pairs(inc: DataFrame, degree: DataFrame, block_size: int, n: int) -> DataFrame:
    """Every unordered pair of a reviewer's products, one join key per unordered pair of product blocks.

    Only reviewers above the block size need their degree joined back: at most rows/block_size of them, so AQE
    broadcasts that frame by measured size and keeps a sort-merge join beyond it.
    """
    hot = degree.filter(F.col("deg") > F.lit(block_size)).select(
        "g", F.ceil(F.col("deg") / F.lit(block_size)).cast("int").alias("nb")
    )
    x = inc.join(hot, "g", "left").select(
        "g", "item", F.coalesce(F.col("nb"), F.lit(1)).alias("nb")
    ).withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    left = x.select(
        "g", F.col("item").alias("a"), F.col("blk").alias("bi"),
        F.explode(F.sequence(F.col("blk"), F.col("nb") - 1)).alias("bj"),
    ).repartition(n, "g", "bi", "bj")
    right = x.select(
        "g", F.col("item").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("bi"),
        F.col("blk").alias("bj"),
    ).repartition(n, "g", "bi", "bj")
    return (
        left.join(right, ["g", "bi", "bj"])
        .filter((F.col("bi") != F.col("bj")) | (F.col("a") < F.col("b")))
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    )


def _listed_pairs(inc: DataFrame, degree: DataFrame, largest: int, block_size: int, n: int) -> DataFrame:
    """``src, dst, weight`` from arrays (``_tails``), shuffled by their first product and counted there."""
    lists = max(inc.sparkSession.sparkContext.defaultParallelism, n // LISTS_SHARE)
    if largest <= block_size:
        tails = _tails(inc, lists)
    else:
        hot = degree.filter(F.col("deg") > F.lit(block_size)).select(
            "g", F.ceil(F.col("deg") / F.lit(block_size)).cast("int").alias("nb")
        )
        tails = _tails(inc.join(hot, "g", "left_anti"), lists).unionByName(_block_tails(inc.join(hot, "g"), n))
    buyers = inc.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if buyers * largest <= PAIRS_PER_TASK:  # no product has more pairs than a task takes
        pairs = tails.repartition(n, "src").select("src", F.explode("dsts").alias("dst"))
        return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    dear = inc.join(degree, "g").groupBy(F.col("item").alias("src")).agg(
        F.ceil(F.sum("deg") / F.lit(PAIRS_PER_TASK)).cast("int").alias("parts")
    )
    dear = materialize(dear.filter(F.col("parts") > 1), "dear-items")
    parted = tails.join(dear, "src", "left").select(
        "src", "dsts", "parts", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    own = F.filter("dsts", lambda dst: F.pmod(F.xxhash64(dst), F.col("parts")) == F.col("part"))
    parted = parted.select("src", "part", F.when(F.col("parts").isNull(), F.col("dsts")).otherwise(own).alias("dsts"))
    pairs = parted.repartition(n, "src", "part").select("src", "part", F.explode("dsts").alias("dst"))
    return pairs.groupBy("src", "part", "dst").agg(F.count(F.lit(1)).alias("weight")).select("src", "dst", "weight")


def _tails(inc: DataFrame, n: int) -> DataFrame:
    """``src, dsts``: for each product of a reviewer the larger ones, as one array."""
    lists = inc.repartition(n, "g").groupBy("g").agg(F.array_sort(F.collect_list("item")).alias("items"))
    placed = lists.select("items", F.posexplode("items").alias("pos", "src"))
    dsts = F.slice("items", F.col("pos") + 2, F.size("items") - F.col("pos") - 1)
    return placed.filter(F.col("pos") + 1 < F.size("items")).select("src", dsts.alias("dsts"))


def _block_tails(inc: DataFrame, n: int) -> DataFrame:
    """``_tails`` of the reviewers above the block size (``nb`` blocks): one join key per ordered pair of blocks.

    A product meets each block of its reviewer once and takes the larger products of it, so every pair is made once.
    """
    x = inc.withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = x.select("g", F.col("blk").alias("bi"), every.alias("bj"), F.col("item").alias("src")).repartition(n, "g", "bi", "bj")
    blocks = x.groupBy("g", "nb", "blk").agg(F.collect_list("item").alias("items"))
    right = blocks.select("g", every.alias("bi"), F.col("blk").alias("bj"), "items").repartition(n, "g", "bi", "bj")
    larger = F.filter("items", lambda dst: dst > F.col("src"))
    return left.join(right, ["g", "bi", "bj"]).select("src", larger.alias("dsts")).filter(F.size("dsts") > 0)


def co_purchase_edges(
    reviews: DataFrame, min_weight: int = 2, block_size: int = DEFAULT_BLOCK,
    group: str = "reviewer_id", item: str = "product_id",
) -> DataFrame:
    """E6/E7 without categories: (src, dst, weight), one stored direction (smaller id first)."""
    return pair_counts(materialize(incidence(reviews, group, item), "incidence"), min_weight, block_size)


def anchored_pair_counts(inc: DataFrame, anchors, min_weight: int = 2) -> DataFrame:
    """Co-purchase weights of a few anchor items with every other item, without the global pair table.

    weight(a, x) = |reviewers(a) ∩ reviewers(x)|: the (reviewer, anchor) rows are joined to the incidence on
    the reviewer and counted per (anchor, other).  Work is linear in the anchors' reviewers' rows; the anchor
    side is small (AQE broadcasts it by measured size) and a hot reviewer on the other side is split by AQE's
    skew join.  Output: anchor, other, weight (weight ≥ min_weight, other ≠ anchor) – exactly the stored
    CO_PURCHASED edges touching the anchors, seen from the anchor.  ``anchors`` is a frame with an ``item``
    column, or a list of ids (then a plain ``isin`` filter that reaches the scan).
    """
    if isinstance(anchors, DataFrame):
        a = inc.join(anchors.select("item").distinct(), "item", "left_semi")
    else:
        a = inc.filter(F.col("item").isin(list(anchors)))
    a = a.select("g", F.col("item").alias("anchor"))
    other = inc.select(F.col("g").alias("__g"), F.col("item").alias("other"))
    return (
        a.join(other, a.g == other.__g)
        .filter(F.col("other") != F.col("anchor"))
        .groupBy("anchor", "other").agg(F.count(F.lit(1)).alias("weight"))
        .filter(F.col("weight") >= F.lit(min_weight))
    )
