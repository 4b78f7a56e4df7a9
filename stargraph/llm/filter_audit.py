"""Interaction audit of a chain of filters: what each filter removes in every order of the filters.

Every document becomes a mask of the filters that it fails.  Documents with the same part, mask and labels behave alike
in every order, so they are counted into cells (at most ``2 ** filters`` masks a part) before anything else.  Each cell
is folded over the array of all orders with ``transform`` and ``aggregate``, which gives one weighted struct per (order,
step): 600 for five filters.  The arrays of a part are merged by adding their elements.  The array of orders is a
literal of fixed size; what is counted is a few numbers per part, however many documents there are.

The filters, on whole texts (words are runs of characters other than ``[\\x20\\x09-\\x0D]``): A under 100 words; B under
80 % distinct words; C more than 10 % capitals; D one of ``#$%&*|``; E the text of a smaller doc_id.  For E the rows of a
text are first counted per part and labels, with the smallest doc_id of each, so a text that a third of all rows hold is
some rows by then, and no row is joined back.  Texts are compared by their SHA-256.

Cases: a null text is an empty one (fails A; equal to other empty ones); a null lang is the part ``''``, together with
an empty lang; a null doc_id is neither smaller nor larger than another, so it never fails E; rows with the same
doc_id and text do not fail E by each other; a label may be repeated, a document is good (toxic) if any of its label
rows has quality (toxic) 1; documents without labels are neither; an empty table gives no part; other columns are not
used, whatever their names.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stargraph.llm.common import text_or_empty

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
WEIGHTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


# ── Masks ────────────────────────────────────────────────────────────────────────────────────────────────
def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > F.char_length(text) * 10,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good ones and toxic ones of each mask in a part."""
    text = text_or_empty(F.col("text"))
    marked = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    alike = ["digest", "mask", "part", "good", "toxic"]
    rows = marked.join(marks, "doc_id", "left").select("doc_id", "digest", "mask", "part", *known)
    rows = rows.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))  # the smallest doc_id and its rows
    groups = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        first.alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    groups = groups.select("part", "mask", "good", "toxic", "n", originals.alias("originals"))
    copy = 1 << FILTERS.index("E")
    counts = F.explode(F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    ))
    split = groups.select("part", "good", "toxic", counts.alias("c")).select("part", "good", "toxic", "c.*")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


# ── Folds ────────────────────────────────────────────────────────────────────────────────────────────────
def orders(filters: str = FILTERS) -> Column:
    """All orders, each an array of the filters' bits (a literal)."""
    return F.array(*[
        F.array(*[F.lit(1 << filters.index(f)) for f in order]) for order in permutations(filters)
    ])


def order_names(filters: str = FILTERS) -> Column:
    return F.array(*[F.lit("".join(order)) for order in permutations(filters)])


def fold(mask: Column, n: Column, good: Column, toxic: Column, every: Column) -> Column:
    """The cell's weighted structs, one per (order, step), in order.

    Along one order a fold carries whether the cell is still there; each step adds a struct of what it does to it.
    """
    zero = F.lit(0).cast("long")

    def weighted(there: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        here = there & fails
        return F.struct(
            F.when(there & ~fails, n).otherwise(zero).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"),
            F.when(~there & fails, n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )

    longs = ", ".join(f"{w}: bigint" for w in WEIGHTS)
    start = F.struct(F.lit(True).alias("there"), F.array().cast(f"array<struct<{longs}>>").alias("steps"))

    def step(at: Column, bit: Column) -> Column:
        return F.struct(
            (at["there"] & (mask.bitwiseAND(bit) == 0)).alias("there"),
            F.concat(at["steps"], F.array(weighted(at["there"], bit))).alias("steps"),
        )

    return F.flatten(F.transform(every, lambda order: F.aggregate(order, start, step, lambda at: at["steps"])))


def audit(cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step`` and the sums of the weights, with ``shapley``: what the step's filter removes in
    the part, over all orders and steps."""
    folded = cell.select("part", fold(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), orders(filters)).alias("w"))
    merged = folded.select("part", F.posexplode("w").alias("at", "w")).groupBy("part", "at").agg(
        *[F.sum(f"w.{w}").alias(w) for w in WEIGHTS]
    )
    k = len(filters)
    order = F.element_at(order_names(filters), (F.floor(F.col("at") / k) + 1).cast("int"))
    steps = merged.select("part", order.alias("filter_order"), (F.col("at") % k + 1).cast("int").alias("step"), *WEIGHTS)
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return steps.withColumn("shapley", F.sum("removed").over(own))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(docs, labels))
