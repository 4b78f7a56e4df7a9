"""Mixing sources to target weights as a time-varying curriculum (DataFrame operations only).

``targets``   words per source: the sources, by code point with null last, weigh ``weights`` repeating and share
              ``share`` times all words; a target stops at ``max_repeats`` times its source's words and the excess
              goes to the others by weight until none is above (one water level over the sorted caps).
``schedules`` each source's weight over training time 0..1 is piecewise linear through knots; it is integrated
              (trapezoids) and scaled so that the whole demand equals the source's target.
``mix``       the documents of a source form a stream in a fixed pseudo-random order (md5 of doc_id).  Its running
              word count is the demand at which a document is due; inverting the cumulative demand gives the
              training position.  The stream is read ``max_repeats`` times at most; ``taken`` is the number
              of words that fall below the target, repeats counted.  The result is range-sorted by position.

Running sums are split: words per (source, bucket of the order), a running sum over the buckets of a source, and
a running sum inside each bucket, so a source that holds a third of all rows is spread over ``BUCKETS`` groups.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is ordered by the digest of the
empty text.  Repeated rows are separate rows.  An empty table gives an empty result; if all sizes are 0, all
targets are 0.  Extra columns pass through; the columns ``size, source_size, target, taken, position`` are
replaced if present, working columns start with ``_mx_``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stargraph.llm.common import text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
BUCKETS = 4096

#: (time, relative weight) knots per weight class: the first fades out, the second is steady, the third grows.
KNOTS = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0)."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, size`` (one row per source) to ``source, source_size, klass, target``.

    The windows here run over one row per source, never over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    klass = F.pmod(place, F.lit(len(weights)))
    weigh = F.get(F.array(*[F.lit(float(w)) for w in weights]), klass)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        sizes.select("source", F.col("size").alias("source_size"), klass.alias("klass"), weigh.alias("weight"))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
        )
        # levels rise up to the first source that its own cap does not cut, and fall from there on
        .withColumn("water", F.max("level").over(everything))
    )
    reached = F.least(F.col("cap"), F.col("water") * F.col("weight"))
    return leveled.select("source", "source_size", "klass", reached.alias("target"))


def _segments(knots: Sequence[Sequence[tuple[float, float]]], klass: Column) -> Column:
    """Per class the pieces of the integrated schedule: demand before, start, length, weight there, slope; the
    demand of the whole schedule is 1."""
    pieces = []
    for line in knots:
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:]))
        done, rows = 0.0, []
        for (t0, w0), (t1, w1) in zip(line, line[1:]):
            w0, w1 = w0 / whole, w1 / whole
            values = dict(done=done, start=t0, weight=w0, slope=(w1 - w0) / (t1 - t0))
            rows.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
            done += (t1 - t0) * (w0 + w1) / 2
        pieces.append(F.array(*rows))
    return F.get(F.array(*pieces), klass)


def position_of(demand: Column, klass: Column, knots: Sequence[Sequence[tuple[float, float]]] = KNOTS) -> Column:
    """The time at which the integrated schedule of a class reaches ``demand`` (0..1 of its whole)."""
    piece = F.element_at(F.filter(_segments(knots, klass), lambda s: s["done"] <= demand), -1)
    rest = demand - piece["done"]
    root = F.sqrt(piece["weight"] * piece["weight"] + piece["slope"] * rest * 2.0)
    return piece["start"] + F.when(rest == 0, F.lit(0.0)).otherwise(rest * 2.0 / (piece["weight"] + root))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    knots: Sequence[Sequence[tuple[float, float]]] = KNOTS,
    share: float = SHARE,
    repeats: int = MAX_REPEATS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` (with ``size``, see :func:`words`) plus ``source_size, target, taken, position``, in training order.

    ``position`` (0..1) is where a document is first read, null if nothing of it is taken; its later readings
    follow at the same demand plus whole passes.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken", "position")]
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring("_mx_order", 1, 8), 16, 10).cast("long"), F.lit(1 << 32))
    bucket = F.floor(bucket * F.lit(buckets) / F.lit(float(1 << 32))).cast("int")
    # a source key that is never null: the running sums and the join below then share one shuffle of the documents
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    # rows with equal id and size, by what else they hold
    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType)
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, plain)])
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept], order.alias("_mx_order"), named.alias("_mx_source"), tie.alias("_mx_tie")
    )
    keyed = keyed.withColumn("_mx_bucket", bucket)

    cells = keyed.groupBy("source", "_mx_source", "_mx_bucket").agg(F.sum("size").alias("cell"))
    per_source = targets(cells.groupBy("source").agg(F.sum("cell").alias("size")), weights, share, repeats)
    earlier = Window.partitionBy("_mx_source").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        "_mx_source", "_mx_bucket", F.coalesce(F.sum("cell").over(earlier), F.lit(0)).alias("_mx_offset")
    )
    plan = offsets.join(
        per_source.select(named.alias("_mx_source"), "source_size", F.col("klass").alias("_mx_klass"), "target"), "_mx_source"
    )

    inside = (
        Window.partitionBy("_mx_source", "_mx_bucket")
        .orderBy("_mx_order", "doc_id", "size", "_mx_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    due = (
        keyed.withColumn("_mx_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan, ["_mx_source", "_mx_bucket"])
        .withColumn("_mx_at", F.col("_mx_offset") + F.col("_mx_before"))
    )
    whole = F.floor("target").cast("long")
    taken = sum(
        (
            F.least(F.greatest(whole - F.col("_mx_at") - F.col("source_size") * k, F.lit(0)), F.col("size"))
            for k in range(1, repeats)
        ),
        F.least(F.greatest(whole - F.col("_mx_at"), F.lit(0)), F.col("size")),
    )
    position = F.when(F.col("taken") > 0, position_of(F.col("_mx_at") / F.col("target"), F.col("_mx_klass"), knots))
    return (
        due.withColumn("taken", taken.cast("long"))
        .withColumn("position", F.round(position, 9))
        .select(*[F.col(f"`{c}`") for c in kept], "source_size", "target", "taken", "position", "_mx_order")
        .repartitionByRange(F.col("position").asc_nulls_last(), "_mx_order")
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "_mx_order")
        .drop("_mx_order")
    )
