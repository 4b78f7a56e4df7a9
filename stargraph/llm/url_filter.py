"""URL filtering by a temporal list join (DataFrame operations only).

A list is a history of dated entries: ``kind`` (``host``, ``domain`` or ``prefix``), ``value``, ``action`` (``block``,
``allow`` or ``expire``) and ``day``.  The entries of one key become validity intervals, each lasting until the key's
next entry; of entries of one key and day the strongest counts (block, then allow, then expire).  Every capture is
evaluated as of the day it was fetched against the entries of its host, of every domain above it (two labels or
more) and of its host with its first path segments, one key per number of segments.  The most specific active entry
decides: longest prefix, host, longest domain.  A prefix ends at a segment, a slash after its last segment does not
count; a prefix without a path stands for URLs without one (``host`` entries hold for all).  Hosts compare without
case and without a dot at their end, paths with case; an address in brackets is a host.

Work is done per distinct (host, path, day), the path cut to as many segments as the longest listed prefix has, and
per distinct (key, day) of listed keys, so a host that holds a third of all captures is one row per day and cut path,
and captures that no entry could be about leave before the shuffles; a key's history has at most one row per day.  The verdicts go back to the captures by a join whose keys are salted.

Nulls: a capture with a null, malformed or over-long host (253 characters), or with a null day, has the verdict
``none``; entries with a null value, day or unknown action are ignored.  Ties and repeated rows: see above, and
captures stay rows of their own.  With no entries every verdict is ``none``.  Extra columns of the captures pass
through, except that ``host, verdict, matched, since`` are replaced; working columns start with ``_uf_``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stargraph.llm.common import materialize

SALTS = 16
_STRENGTH = ("expire", "allow", "block")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)"  # user info ends at the last @; [..]: an address
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host without a dot at its end, null if there is none or it is longer than a host name can be."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when((host != "") & (F.length(host) <= 253), host)


def segment_of(url: Column) -> Column:
    """The first path segment with its slash (empty text if there is no path)."""
    return F.regexp_extract(url, _SEGMENT, 1)


def path_of(url: Column, depth: int) -> Column:
    """The first ``depth`` path segments with their slashes (empty text if there is no path)."""
    return F.array_join(F.slice(F.split(F.regexp_extract(url, _PATH, 1), "/", -1), 1, depth + 1), "/")


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), value)


def candidate_keys(host: Column, path: Column) -> Column:
    """``array<struct<rank: int, key: string>>``, the most specific key with the highest rank."""
    labels = F.split(host, r"\.", -1)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(
            (F.size(labels) - i + 1).alias("rank"),
            _key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("key"),
        ),
    )
    segments = F.split(path, "/", -1)  # the first is empty
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))),
        lambda i: F.struct(
            (i + 1000).alias("rank"),
            _key("prefix", F.concat(host, F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))).alias("key"),
        ),
    )
    exact = F.array(F.struct(F.lit(1000).alias("rank"), _key("host", host).alias("key")))
    return F.concat(prefixes, exact, domains)


def _listed() -> Column:
    """An entry's value: its host lower-cased and without a dot at its end, the path as it is, without slashes after a
    last segment."""
    host = F.regexp_replace(F.lower(F.regexp_extract("value", "^[^/]*", 0)), r"\.$", "")
    path = F.regexp_replace(F.regexp_replace("value", "^[^/]*", ""), "^(/.*[^/])/+$", "$1")
    return F.when(F.col("kind") == "prefix", F.concat(host, path)).otherwise(F.regexp_replace(F.lower("value"), r"\.$", ""))


def depth_of(entries: DataFrame) -> int:
    """Path segments of the longest listed prefix, at least 1."""
    slashes = F.regexp_count(_listed(), F.lit("/"))
    return max(1, entries.filter(F.col("kind") == "prefix").agg(F.max(slashes)).first()[0] or 0)


def history(entries: DataFrame) -> DataFrame:
    """``key, day, strength``: one row per key and day (the strongest action as its place in ``_STRENGTH``)."""
    strength = F.array_position(F.array(*[F.lit(a) for a in _STRENGTH]), F.col("action")) - 1
    return (
        entries.filter(F.col("kind").isin("host", "domain", "prefix") & F.col("value").isNotNull() & F.col("day").isNotNull())
        .filter(F.col("action").isin(*_STRENGTH))
        .groupBy(F.concat_ws(":", "kind", _listed()).alias("key"), "day")
        .agg(F.max(strength).alias("strength"))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, valid_from, valid_to``: the history as validity intervals (open end: null)."""
    order = Window.partitionBy("key").orderBy("day")
    return history(entries).select(
        "key",
        F.element_at(F.array(*[F.lit(a) for a in _STRENGTH]), F.col("strength").cast("int") + 1).alias("action"),
        F.col("day").alias("valid_from"),
        F.lead("day").over(order).alias("valid_to"),
    )


def as_of(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``key, day, action, since`` for every asked (key, day) that an interval other than ``expire`` covers.

    Borders and questions of one key are merged by day; the last border at or before a question is its interval.
    """
    borders = intervals(entries).select(
        "key", F.col("valid_from").alias("day"), F.struct(F.col("valid_from").alias("since"), "action").alias("entry"),
        F.lit(0).alias("asks"),
    )
    questions = asked.select("key", "day", F.lit(None).cast(borders.schema["entry"].dataType).alias("entry"), F.lit(1).alias("asks"))
    order = Window.partitionBy("key").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        borders.unionByName(questions)
        .withColumn("entry", F.last("entry", ignorenulls=True).over(order))
        .filter((F.col("asks") == 1) & (F.col("entry.action") != "expire"))
        .select("key", "day", F.col("entry.action").alias("action"), F.col("entry.since").alias("since"))
    )


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """``captures`` (``url, day``) plus ``host, verdict`` (block, allow, none)``, matched, since``."""
    entries = materialize(entries, "url-entries")
    kept = [c for c in captures.columns if c not in ("host", "verdict", "matched", "since")]
    rows = captures.select(
        *[F.col(f"`{c}`") for c in kept], host_of(F.col("url")).alias("host"), path_of(F.col("url"), depth_of(entries)).alias("_uf_path")
    )
    combos = (
        rows.filter(F.col("host").isNotNull() & F.col("day").isNotNull())
        .select("host", "_uf_path", "day")
        .distinct()
        .withColumn("_uf_key", F.explode(candidate_keys(F.col("host"), F.col("_uf_path"))))
        .select("host", "_uf_path", "day", F.col("_uf_key.rank").alias("rank"), F.col("_uf_key.key").alias("key"))
        .join(history(entries).select("key").distinct(), "key", "left_semi")
    )
    answers = as_of(combos.select("key", "day").distinct(), entries)
    best = (
        combos.join(answers, ["key", "day"])
        .groupBy("host", "_uf_path", "day")
        .agg(F.max(F.struct("rank", "action", "key", "since")).alias("_uf_best"))
    )
    spread = best.select(
        F.col("host").alias("_uf_host"),
        F.col("_uf_path").alias("_uf_seg"),
        F.col("day").alias("_uf_day"),
        "_uf_best",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_uf_of"),
    )
    salted = rows.withColumn("_uf_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept]), F.lit(salts)).cast("int"))
    same = (
        (F.col("host") == F.col("_uf_host"))
        & (F.col("_uf_path") == F.col("_uf_seg"))
        & (F.col("day") == F.col("_uf_day"))
        & (F.col("_uf_salt") == F.col("_uf_of"))
    )
    return salted.join(spread, same, "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        F.coalesce(F.col("_uf_best.action"), F.lit("none")).alias("verdict"),
        F.col("_uf_best.key").alias("matched"),
        F.col("_uf_best.since").alias("since"),
    )


#: Days since 1970-01-01 on which the query's captures begin, and how many days they span.
FIRST_DAY, DAYS = 19_723, 365


def derived_captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, day``: the pages table has no fetch time, so the day follows from the page_id."""
    return pages.select("page_id", "url", (F.lit(FIRST_DAY) + F.pmod(F.col("page_id") * 37, F.lit(DAYS))).alias("day"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, parent domains and host prefixes of all pages, from digests of their names.

    Hosts: three in eight are blocked for some weeks, half of these again later.  Parent domains: a quarter is
    blocked from some day on.  Prefixes of one segment: one in eight is allowed from some day on; of two segments, with
    their host in capitals and a slash at their end: one in eight is blocked from some day on.
    """
    named = pages.select(
        host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"), path_of(F.col("url"), 2).alias("path")
    )
    named = named.filter(F.col("host").isNotNull()).distinct()

    def listed(kind: str, value: Column) -> DataFrame:
        digest = F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.col("value")).cast("binary")), 1, 8), 16, 10)
        return (
            named.select(value.alias("value"))
            .filter(F.col("value").isNotNull())
            .distinct()
            .select(F.lit(kind).alias("kind"), "value", digest.cast("long").alias("d"))
        )

    def dated(rows: DataFrame, action: str, day: Column) -> DataFrame:
        return rows.select("kind", "value", F.lit(action).alias("action"), (F.lit(FIRST_DAY) + day).alias("day"))

    hosts = listed("host", F.col("host")).filter(F.col("d") % 8 < 3)
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", ""))
    domains = listed("domain", parent).filter(F.col("d") % 4 == 0)
    prefixes = listed("prefix", F.concat("host", "segment")).filter(F.col("d") % 8 == 0)
    two = F.when(F.size(F.split("path", "/", -1)) == 3, F.concat(F.upper("host"), F.col("path"), F.lit("/")))
    deeper = listed("prefix", two).filter(F.col("d") % 8 == 1)
    begin = F.floor(F.col("d") / 8) % 200
    return (
        dated(hosts, "block", begin)
        .unionByName(dated(hosts, "expire", begin + 30 + F.col("d") % 60))
        .unionByName(dated(hosts.filter(F.floor(F.col("d") / 1024) % 2 == 0), "block", begin + 120))
        .unionByName(dated(domains, "block", begin))
        .unionByName(dated(prefixes, "allow", begin))
        .unionByName(dated(deeper, "block", begin))
    )
