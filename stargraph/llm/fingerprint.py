"""Document fingerprints by consistent weighted sampling (DataFrame operations only).

A text is its words ``[^\\x20\\x09-\\x0D]+`` weighted by how often they occur.  For each of ``SAMPLES`` samples and each
weighted term (word, S) draw r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (word, sample) and take
t = floor(ln S / r + b), ln a = ln c - r (t - b + 1); the sample is the term and t with the smallest a.  Two
texts pick the same sample with a probability equal to their generalised Jaccard similarity
sum min(S1, S2) / sum max(S1, S2) (improved consistent weighted sampling).

Since the smallest ln a belongs to one (word, t) only, the sample is kept as 16 bits of its hash: a fingerprint is
``4 * SAMPLES`` hex digits, equal for equal texts.  A text without words has the fingerprint ``"-"``; it is like
another such text (1.0) and unlike all others (0.0).

``neighbours`` pairs every document with the next one by ascending doc_id (after the last: the first) without a
global sort in one task: ranges of doc_id, each of which also receives the first rows of the next range.

Nulls: a null text is empty; a null doc_id comes before all others.  Equal ids and repeated rows are ordered by
text and stay rows of their own.  One document is its own next.  An empty table gives an empty result.  Extra
columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stargraph.llm.common import text_or_empty

SAMPLES = 32
RANGES = 512
RANGE_ROWS = 20_000
MOST_RANGES = 16_384
_BITS = 21


def _uniform(bits: Column, at: int) -> Column:
    """A number in (0, 1) from ``_BITS`` bits of a hash."""
    part = F.shiftrightunsigned(bits, at * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (part.cast("double") + 0.5) * (0.5**_BITS)


def _log_a(term: Column, log_weight: Column, sample: int) -> Column:
    """ln a of a weighted term in one sample."""
    one = F.xxhash64(term, F.lit(2 * sample))
    two = F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.log(_uniform(one, 0) * _uniform(one, 1))
    c = -F.log(_uniform(two, 0) * _uniform(two, 1))
    # the third parts of both hashes make one uniform number of 42 bits
    b = _uniform(one, 2) + (_uniform(two, 2) - 0.5) * (0.5**_BITS)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b + 1.0)


def weighted_terms(text: Column) -> Column:
    """``array<struct<term: long, weight: int>>``: the hashed words and how often they occur."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return _let(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), _runs)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (an expression used inside a lambda runs once per element)."""
    return F.get(F.transform(F.array(value), body), 0)


def _runs(ordered: Column) -> Column:
    """Runs of equal values: each starts where the one before differs and ends where the next starts."""
    marks = F.transform(ordered, lambda h, i: F.when((i == 0) | (F.get(ordered, i - 1) != h), i))
    return _let(
        F.filter(marks, lambda i: i.isNotNull()),
        lambda firsts: F.transform(
            firsts,
            lambda i, n: F.struct(
                F.get(ordered, i).alias("term"),
                (F.coalesce(F.get(firsts, n + 1), F.size(ordered)) - i).alias("weight"),
            ),
        ),
    )


def signatures(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """``key, fingerprint`` for rows ``key, text``; ``key`` must be unique.

    The terms are exploded and reduced to one row of minima per key.  If ``texts`` is partitioned by a part of the
    key, nothing is shuffled.
    """
    terms = texts.select(*key, F.explode_outer(weighted_terms(F.col("text"))).alias("t"))
    weighted = terms.select(*key, F.col("t.term").alias("term"), F.log(F.col("t.weight").cast("double")).alias("lw"))
    least = weighted.groupBy(*key).agg(
        *[F.min(_log_a(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)]
    )
    digits = [F.lpad(F.hex(F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFF))), 4, "0") for k in range(samples)]
    return least.select(
        *key, F.when(F.col("s0").isNull(), F.lit("-")).otherwise(F.lower(F.concat(*digits))).alias("fingerprint")
    )


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(one, 4 * k + 1, 4) == F.substring(two, 4 * k + 1, 4)).cast("double") for k in range(samples)]
    return F.when((one == "-") | (two == "-"), (one == two).cast("double")).otherwise(
        sum(same[1:], same[0]) / float(samples)
    )


def _numbers(values: list[int]) -> Column:
    """A constant array from one literal (a literal for every element would make a large plan)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(low: Column, borders: list[int]) -> tuple[Column, Column]:
    """The place of the last border that is not above ``low``, found in two steps, and the borders as an array."""
    step = max(1, math.isqrt(len(borders)))
    first = _numbers(borders)
    block = F.size(F.filter(_numbers(borders[::step]), lambda b: b <= low)) - 1
    return _let(
        block, lambda k: k * step + F.size(F.filter(F.slice(first, k * step + 1, F.lit(step)), lambda b: b <= low)) - 1
    ), first


def neighbours(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``part, at, doc_id, text, guest, next_text``: the rows of each range of doc_id in order, each with the text
    of the next row.  There are ``ranges`` ranges, more if one would hold over ``RANGE_ROWS`` rows (``MOST_RANGES`` at
    most: larger ranges are sorted on disk).  Guests are the rows of the next range that a range's last row needs; callers drop them when
    they have used them.  The result is partitioned by ``part``; (``part``, ``at``) is unique.
    """
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id"), text_or_empty(F.col("text")).alias("text"), low.alias("low"))
    smallest, count = rows.agg(F.min("low"), F.count(F.lit(1))).first()
    ranges = max(ranges, min(MOST_RANGES, count // RANGE_ROWS))
    shares = [i / ranges for i in range(ranges + 1)]
    # values of the column itself, so every border is the first id of its range
    borders = rows.agg(F.percentile_approx("low", shares, 10 * max(ranges, 1000))).first()[0] or []
    borders = sorted({*borders, smallest} - {None}) or [0]
    part, first = _range_of(F.col("low"), borders)
    before = F.pmod(F.col("part") - 1, F.lit(len(borders)))
    placed = rows.withColumn("part", part)
    host = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(before.alias("part"), F.lit(True).alias("guest")))
    hosts = F.when(F.get(first, F.col("part")) == F.col("low"), F.concat(host, guest)).otherwise(host)
    dealt = placed.withColumn("host", F.explode(hosts)).select("doc_id", "text", "low", "host.part", "host.guest")
    order = Window.partitionBy("part").orderBy("guest", "low", F.col("doc_id").isNotNull(), F.xxhash64("text"))
    return dealt.select(
        "part",
        F.row_number().over(order).alias("at"),
        "doc_id",
        "text",
        "guest",
        F.lead("text").over(order).alias("next_text"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of ``text`` (rounded down) replaced by as many first code points of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def report(docs: DataFrame, samples: int = SAMPLES, ranges: int = RANGES) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likeness to it and to the next one's."""
    rows = neighbours(docs, ranges).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    both = rows.select(
        "part",
        "at",
        "doc_id",
        "guest",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(
            F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
        ).alias("v"),
    ).select("part", "at", "doc_id", "guest", "n_chars", "edited_sha256", "v.kind", "v.text")
    key = ["part", "at", "doc_id", "guest", "n_chars", "edited_sha256", "kind"]
    prints = signatures(both, key, samples)
    pairs = prints.groupBy(*key[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    following = F.lead("fingerprint").over(Window.partitionBy("part").orderBy("at"))
    return (
        pairs.withColumn("next_fingerprint", following)
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        )
    )
