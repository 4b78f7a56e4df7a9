"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased, held as two 64-bit
hashes.  ``LineRuns`` is the index: each batch of documents is aggregated to one row per key (number of documents,
largest doc_id), merge-anti-joined against the keys that the runs have settled, and what is left is written as
a run sorted by hash on level 0.  ``fanout`` runs of one level are compacted into one run of the next, so a key
is rewritten once per level.  A key is settled for a batch when the runs already count ``min_docs`` documents for
it and hold a doc_id that is not smaller: the batch can then change neither what is dropped nor who keeps it.

``dedup`` drops, in every document but the one with the largest doc_id, the lines whose key has at least
``min_chars`` code points and occurs in at least ``min_docs`` documents.

Nulls: a null text is one empty line; a null doc_id is one document, smaller than every other.  Rows with the same
doc_id are one document for the counts and stay rows of their own in the result.  A text that loses all lines
becomes empty.  Extra columns pass through ``dedup`` (names that clash with its own working columns are safe:
those start with ``_ld_``).  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stargraph.llm.common import BLANKS, ascii_lower, materialize, text_or_empty
from stargraph.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 4


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty(F.col("text")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        F.col("doc_id"),
        _text_hash().alias("text_hash"),
        F.posexplode(F.split(ascii_lower(text_or_empty(F.col("text"))), "\n", -1)).alias("pos", "line"),
    )
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    return (
        lines.withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


class LineRuns:
    """The levelled sorted runs; ``root`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark = spark
        self.root = root or scratch_path(spark, "line-runs")
        self.min_docs = min_docs
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self._written = 0

    def keys(self) -> DataFrame | None:
        """``h1, h2, n_docs, keeper`` over all runs (None before the first batch)."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        return self._merged(self.spark.read.parquet(*runs)) if len(runs) > 1 else self.spark.read.parquet(*runs)

    def add(self, lines: DataFrame) -> None:
        """Index one batch (``doc_id, h1, h2``); no document may be split over batches."""
        own = (
            lines.select("h1", "h2", "doc_id")
            .distinct()
            .groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        )
        known = self.keys()
        if known is not None:
            settled = known.filter(F.col("n_docs") >= self.min_docs).select(
                F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("keeper").alias("largest")
            )
            beaten = F.coalesce(F.col("keeper") <= F.col("largest"), F.col("keeper").isNull())
            own = own.join(
                settled.hint("merge"), (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & beaten, "left_anti"
            )
        self._push(0, self._write(own))

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def _write(self, keys: DataFrame) -> str:
        path = f"{self.root}/run-{self._written:06d}"
        self._written += 1
        keys.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(self._merged(self.spark.read.parquet(*self.levels[level])))
            self.levels[level] = []
            self._push(level + 1, merged)


def index_in_batches(lines: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> LineRuns:
    """Runs over all ``lines``, fed in ranges of doc_id from the largest down.

    The range borders only balance the batches; the index does not depend on them.
    """
    runs = LineRuns(lines.sparkSession, min_docs=min_docs)
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    borders = lines.agg(F.percentile_approx("doc_id", [*shares, 0.0])).first()[0] if shares else None
    upper = None
    for low in dict.fromkeys(borders[:-1] if borders else []):
        within = F.col("doc_id") >= low
        runs.add(lines.filter(within if upper is None else within & (F.col("doc_id") < upper)))
        upper = low
    runs.add(lines if upper is None else lines.filter(F.col("doc_id").isNull() | (F.col("doc_id") < upper)))
    return runs


def dropped_lines(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """``doc_id, text_hash, drop``: the positions of the lines that go, per text."""
    common = (
        runs.keys()
        .filter(F.col("n_docs") >= runs.min_docs)
        .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "keeper")
    )
    return (
        lines.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("drop"))
    )


def dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """All columns of ``docs`` with ``text`` deduplicated, and ``_ld_lines``, ``_ld_dropped`` (long)."""
    lines = materialize(line_hashes(docs, min_chars), "line-hashes")
    drops = dropped_lines(lines, index_in_batches(lines, batches, min_docs)).select(
        F.col("doc_id").alias("_ld_id"), F.col("text_hash").alias("_ld_hash"), F.col("drop").alias("_ld_drop")
    )
    marked = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (_text_hash() == F.col("_ld_hash")), "left")
    split = F.split(text_or_empty(F.col("text")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_split") - 1), F.col("_ld_drop"))
    text = F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("_ld_split", i)), "\n")
    )
    out = marked.withColumn("_ld_split", split).select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size("_ld_split").cast("long").alias("_ld_lines"),
        F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("_ld_dropped"),
    )
    return out


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_dropped").alias("n_dropped"),
        F.sha2(text_or_empty(F.col("text")), 256).alias("kept_sha256"),
    )
