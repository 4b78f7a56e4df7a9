"""Records of CSV files, cut block by block however large a file is.

A quoted field may hold line breaks, so whether a line starts a record depends on everything before it – but only through
one of two states: outside quotes (a record starts) or inside a quoted field.  Each line maps the state before it to the
state after it; a quote counts only where a field starts, where it is doubled and where it closes, so a stray quote
inside an unquoted field changes nothing.  Four states are followed inside a line (field start, unquoted, quoted, quote
seen in quoted); at a line's end two of them are left.

1.  Every block composes the maps of its lines and keeps the lines that would finish a record begun before it.
2.  The maps of a file's blocks (one small row each) are composed in order: the state at the start of every block, and
    for each block the text by which later blocks finish its last record.
3.  Every block is read again, cut into records from its known state, and its last record completed.

No line is shuffled.  The rows of step 2 are broadcast up to ``BROADCAST_BLOCKS`` of them; beyond that the lines are
joined to them and put back in order by block.  A record of more than ``RECORD_BYTES`` bytes is not assembled: it is a
bad record (``record`` null, its size known), so one unclosed quote costs its record, not the job.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

RECORD_BYTES = 4 << 20
BROADCAST_BLOCKS = 20_000  # with a line or two of text each; checked again in bytes
BROADCAST_BYTES = 64 << 20

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # a quoted field up to its closing quote, or to the line's end
_FIELDS = rf'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'  # whole fields; possessive, so the match runs in a loop
OPEN_AT_START = rf"\A{_FIELDS}{_QUOTED}\z"
OPEN_INSIDE = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_FIELDS}{_QUOTED}\z)'


def line_map(line: Column) -> Column:
    """The state after a line (1: inside quotes) if it starts outside (bit 0) and inside quotes (bit 1)."""
    value = F.when(line.rlike(OPEN_AT_START), 1).otherwise(0) + F.when(line.rlike(OPEN_INSIDE), 2).otherwise(0)
    return F.when(F.contains(line, F.lit('"')), value).otherwise(2).cast("byte")


# ── In a task: lines in order ────────────────────────────────────────────────────────────────────────────
def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Stretches of rows of one block: ``(file, block), from, to``."""
    f, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    bounds = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(f)]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield (int(f[lo]), int(b[lo])), lo, hi


def _states(maps: np.ndarray, start: int) -> np.ndarray:
    """The state after each line.  A line keeps the state, swaps it, or sets it; what it set last counts."""
    swaps = np.cumsum(maps == 1)
    sets = np.maximum.accumulate(np.where((maps == 0) | (maps == 3), np.arange(len(maps)), -1))
    known = sets >= 0
    base = np.where(known, (maps[sets] == 3).astype(np.int64) ^ swaps[sets] & 1, start)
    return base ^ swaps & 1


class _Text:
    """Lines of one record, forgotten once they are too long; their size is counted on."""

    def __init__(self):
        self.lines, self.size, self.any = [], -1, False

    def add(self, lines: pa.Array, limit: int) -> None:
        if len(lines):
            self.any = True
            self.size += int(pc.sum(pc.binary_length(lines)).as_py()) + len(lines)
            self.lines = [*self.lines, lines] if self.size <= limit else []

    def joined(self, limit: int) -> bytes | None:
        return b"\n".join(x for lines in self.lines for x in lines.to_pylist()) if self.any and self.size <= limit else None


def _summaries(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Per block: the composed map, and the lines up to where a start inside quotes gets outside."""
    key, ends, head, closed = None, [0, 1], _Text(), False

    def row() -> pa.RecordBatch:
        values = [key[0], key[1], ends[0], ends[1], closed, head.size, head.joined(limit)]
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)], ["f", "b", "outside", "inside", "closes", "size", "head"]
        )

    for batch in batches:
        lines = batch.column(3).cast(pa.binary())
        maps_all = batch.column(2).to_numpy(zero_copy_only=False)
        for found, lo, hi in _runs(batch):
            if found != key:
                if key is not None:
                    yield row()
                key, ends, head, closed = found, [0, 1], _Text(), False
            maps = maps_all[lo:hi]
            if not closed:
                after = _states(maps, ends[1])
                out = np.flatnonzero(after == 0)
                closed = len(out) > 0
                head.add(lines[lo : lo + out[0] + 1 if closed else hi], limit)
            ends = [int(_states(maps, e)[-1]) for e in ends]
    if key is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Records that start in each block.  Columns: file, block, line map, line, start state, rest, size of the rest."""
    key, state, skipping, first = None, 0, False, False
    text, rest, rest_size = _Text(), None, None

    def out(records: pa.Array, sizes: pa.Array) -> pa.RecordBatch:
        """Blank records are dropped here; the first other one of a file is marked."""
        nonlocal first
        blank = pc.or_(pc.equal(sizes, 0), pc.and_(pc.equal(sizes, 1), pc.fill_null(pc.equal(records, b"\r"), False)))
        keep = pc.invert(blank)
        records, sizes = records.filter(keep), sizes.filter(keep)
        marks = np.zeros(len(records), bool)
        if first and len(marks):
            marks[0], first = True, False
        return pa.RecordBatch.from_arrays([pa.array(marks), sizes, records], ["first", "size", "record"])

    def last() -> Iterator[pa.RecordBatch]:
        """The block's open record, completed by later blocks."""
        if text.any and not skipping:
            size = text.size + (1 + rest_size if rest_size is not None else 0)
            own = text.joined(limit)
            whole = own if rest_size is None or own is None else None if rest is None else own + b"\n" + rest
            yield out(pa.array([whole if size <= limit else None], pa.binary()), pa.array([size], pa.int64()))

    for batch in batches:
        lines = batch.column(3).cast(pa.binary())
        maps_all = batch.column(2).to_numpy(zero_copy_only=False)
        for found, lo, hi in _runs(batch):
            if found != key:
                yield from last()
                key, text = found, _Text()
                state = batch.column(4)[lo].as_py()
                rest, rest_size = batch.column(5)[lo].as_py(), batch.column(6)[lo].as_py()
                skipping, first = state == 1, found[1] == 0
            after = _states(maps_all[lo:hi], state)
            state = int(after[-1])
            ends = np.flatnonzero(after == 0) + 1  # records end after these lines
            if not len(ends):
                text.add(lines[lo:hi], limit)
                continue
            text.add(lines[lo : lo + ends[0]], limit)
            if not skipping:
                whole = text.joined(limit)
                yield out(pa.array([whole], pa.binary()), pa.array([text.size], pa.int64()))
            skipping = False
            if len(ends) > 1:
                inner = lines[lo + ends[0] : lo + ends[-1]]
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), inner), b"\n")
                sizes = pc.binary_length(records).cast(pa.int64())
                yield out(pc.if_else(pc.greater(sizes, limit), pa.scalar(None, pa.binary()), records), sizes)
            text = _Text()
            text.add(lines[lo + ends[-1] : hi], limit)
    yield from last()


# ── Blocks of a file, in order ───────────────────────────────────────────────────────────────────────────
def _resolve(blocks: DataFrame, limit: int) -> DataFrame:
    """``f, b, start, rest, rest_size``: the state at the start of each block and the end of its last record."""
    order = Window.partitionBy("f").orderBy("b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("outside") == 1) & (F.col("inside") == 0)).cast("int")
    sets = F.col("outside") == F.col("inside")
    known = blocks.withColumn("swaps", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    base = F.last(F.when(sets, (F.col("outside") + F.col("swaps")) % 2), ignorenulls=True).over(before)
    earlier = F.coalesce(F.lag("swaps").over(order), F.lit(0))
    known = known.withColumn("start", ((F.coalesce(base, F.lit(0)) + earlier) % 2).cast("byte"))
    through = (F.col("start") == 1) & ~F.col("closes")
    owner = F.last(F.when(~through, F.col("b")), ignorenulls=True).over(before)
    known = known.withColumn("owner", F.when(F.col("start") == 1, owner))
    ends = known.filter(F.col("owner").isNotNull())
    upto = Window.partitionBy("f", "owner").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("upto", F.sum(F.col("size") + 1).over(upto) - 1)
    rest = ends.groupBy("f", F.col("owner").alias("b")).agg(
        F.max("upto").alias("rest_size"),
        F.array_sort(F.collect_list(F.when(F.col("upto") <= limit, F.struct("b", "head")))).alias("heads"),
    )  # a text too long is null from there on: at most ``limit`` bytes are gathered
    newline = F.lit(b"\n")
    joined = F.aggregate(
        F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), F.element_at("heads", 1)["head"],
        lambda text, h: F.concat(text, newline, h["head"]),
    )
    rest = rest.select("f", "b", "rest_size", F.when(F.col("rest_size") <= limit, joined).alias("rest"))
    return known.select("f", "b", "start").join(rest, ["f", "b"], "left").select("f", "b", "start", "rest", "rest_size")


def records(
    spark: SparkSession, path: str | list[str], prepare=lambda line: line, limit: int = RECORD_BYTES,
    broadcast_blocks: int = BROADCAST_BLOCKS,
) -> DataFrame:
    """``first, size, record``: the records of CSV files as text, without blank ones; ``first`` marks each file's
    first (its header), ``size`` counts bytes, ``record`` is null above ``limit`` bytes.

    ``prepare`` is applied to every line before anything else.  The blocks are those of
    ``spark.sql.files.maxPartitionBytes``.  Reads the files once when called (the blocks' maps) and once when used.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        prepare(F.col("value")).alias("value"),
    )
    lines = lines.select("f", "b", line_map(F.col("value")).alias("m"), "value")
    summary = "f long, b long, outside byte, inside byte, closes boolean, size long, head binary"
    blocks = materialize(lines.mapInArrow(partial(_summaries, limit=limit), summary), "csv-blocks")
    starts = materialize(_resolve(blocks, limit), "csv-starts")
    n, text = starts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("rest")), F.lit(0))).first()
    columns = ["f", "b", "m", "value", "start", "rest", "rest_size"]
    if n <= broadcast_blocks and text <= BROADCAST_BYTES:
        ordered = lines.join(F.broadcast(starts), ["f", "b"]).select(*columns)
    else:
        ordered = lines.withColumn("i", F.monotonically_increasing_id()).join(starts, ["f", "b"]).repartition("f", "b")
        ordered = ordered.sortWithinPartitions("f", "b", "i").select(*columns)
    cut = ordered.mapInArrow(partial(_cut, limit=limit), "first boolean, size long, record binary")
    return cut.select("first", "size", F.regexp_replace(F.col("record").cast("string"), "\r\\z", "").alias("record"))
