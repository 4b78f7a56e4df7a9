"""Benchmark decontamination by word-level Wu-Manber multi-pattern search.

Texts become words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  The test strings are all
windows of ``window`` consecutive words of the benchmark items (an item with fewer words, but not none, is one
window).  Per window length there is one searcher: a shift table over blocks of words says how far the next
possible window end is, the strings of a suffix block lie together, ordered by a hash of their words, and a direct
comparison of the words confirms each occurrence.

The benchmark is the query set: Spark makes its tables (arrays, about 40 bytes a word) in blocks whose size is bounded
in bytes (``block_bytes``; one item at least) and writes them.  The driver holds one block at a time, ships it to the
tasks and runs it against all documents in whole; with several blocks each pass is written before the next begins, and
the results are merged per document.

Nulls: a null text has no words; a null ``item_id`` is searched and its hits count, but it adds no id.
Repeated documents keep their multiplicity, repeated items count once per ``item_id``.  Empty tables: no rows,
or no hits.  Extra columns are ignored by ``report``, kept by ``clean``.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargraph.llm.common import ascii_lower, by_value, materialize, text_or_empty

WINDOW = 10
SUFFIX_BLOCK = 2
BLOCK_BYTES = 32 << 20  # estimated size of the tables of a block
WORD_BYTES = 32  # bytes of the tables per word of the benchmark, its text aside
_GROUP = 1 << 20  # bytes of texts that are searched together
_PIECE = 1 << 16  # bytes that are hashed at a time
_HASHED = 64  # bytes of a word that its hash looks at, besides its length
_RUN = 1 << 18  # words whose shifts are looked up at a time
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower-cased text
_FACTOR, _PAIR, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

# every byte that is not part of a word becomes a blank; A-Z become a-z
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of words: a polynomial over their first bytes from running sums, with their length."""

    def __init__(self):
        size = _PIECE + _HASHED
        self.power = np.cumprod(np.full(size, _FACTOR, np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(_FACTOR, -1, 1 << 64), np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        until = np.minimum(ends, starts + _HASHED)
        sums = np.zeros(_PIECE + _HASHED + 1, np.uint64)
        for lo in range(0, len(data), _PIECE):
            a, b = np.searchsorted(starts, (lo, lo + _PIECE))
            part = data[lo : lo + _PIECE + _HASHED]
            np.cumsum(part * self.power[: len(part)], out=sums[1 : len(part) + 1])
            at = starts[a:b] - lo
            out[a:b] = (sums[until[a:b] - lo] - sums[at]) * self.inverse[at]
        return _mixed(out + (ends - starts).astype(np.uint64) * np.uint64(_PAIR))


class Words:
    """The words of some texts, one text after the other: their places in ``flat`` and their hashes.

    ``first`` has the number of the first word of each text, and the number of all words at its end.
    """

    def __init__(self, texts: list[bytes], hasher: Hasher):
        self.flat = b" ".join(texts).translate(_NORMAL)
        data = np.frombuffer(self.flat, np.uint8)
        edges = np.flatnonzero(np.diff(data != 32, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)
        self.hash = hasher(data, self.starts, self.ends)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def string(self, start: int, length: int) -> bytes:
        return b" ".join(self.flat[self.starts[start] : self.ends[start + length - 1]].split())


class Searcher:
    """Wu-Manber tables over test strings (runs of words) of one length, in arrays.

    ``shift`` is indexed by the hash of a block of words; blocks that share a place have the smaller shift there.  The
    test strings are ordered by the place of their last block and then by a hash of all their words, so those of one
    suffix block lie together.  ``texts[begin[s]:end[s]]`` is the string s, ``items[item_at[s]:item_at[s + 1]]`` are the
    numbers of its items.
    """

    def __init__(self, words: Words, at: np.ndarray, item: np.ndarray, length: int, block: int = SUFFIX_BLOCK):
        self.length, self.block = m, b = length, min(block, length)
        self.bits = max(8, (4 * len(at)).bit_length())
        place = self.places(words.hash)
        self.shift = np.full(1 << self.bits, min(m - b + 1, 255), np.uint8)
        for end in range(b, m + 1):  # smaller shifts come later
            self.shift[place[at + end - b]] = min(m - end, 255)
        key = self.keys_of(words.hash, at)
        order = np.argsort(key, kind="stable")
        runs = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        sizes = np.diff(runs, append=len(order))
        reps, counts, items = [order[runs[sizes == 1]]], [np.ones((sizes == 1).sum(), np.int64)], [item[order[runs[sizes == 1]]]]
        for lo, n in zip(runs[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            same: dict[bytes, tuple[int, set[int]]] = {}
            for i in order[lo : lo + n].tolist():
                same.setdefault(words.string(int(at[i]), m), (i, set()))[1].add(int(item[i]))
            reps.append(np.array([i for i, _ in same.values()]))
            counts.append(np.array([len(numbers) for _, numbers in same.values()]))
            items.extend(np.array(sorted(numbers)) for _, numbers in same.values())
        reps, counts, items = (np.concatenate(parts) for parts in (reps, counts, items))
        order = np.argsort(key[reps], kind="stable")
        upto = np.cumsum(counts)
        took = np.repeat((upto - counts)[order], counts[order])
        self.item_at = np.concatenate([[0], np.cumsum(counts[order])]).astype(np.int32)
        self.items = items[took + np.arange(len(items)) - np.repeat(self.item_at[:-1], counts[order])].astype(np.int32)
        self.keys = key[reps][order]
        self.begin = words.starts[at[reps]][order].astype(np.int32)
        self.end = words.ends[at[reps] + m - 1][order].astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place in ``shift`` of each block of words."""
        x = hashes if self.block == 1 else hashes[: 1 - self.block] * np.uint64(1)
        for j in range(1, self.block):
            x = x * np.uint64(_PAIR) + hashes[j : len(hashes) - self.block + 1 + j]
        return (_mixed(x) >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys_of(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the last block and hash of all words of the strings that start at some words."""
        whole = np.zeros(len(at), np.uint64)
        for j in range(self.length):
            whole = whole * np.uint64(_FACTOR) + hashes[at + j]
        last = np.stack([hashes[at + self.length - self.block + j] for j in range(self.block)], axis=1).ravel()
        place = self.places(last)[:: self.block].astype(np.uint64)
        return (place << np.uint64(64 - self.bits)) | (_mixed(whole) >> np.uint64(self.bits))

    def candidates(self, words: Words) -> np.ndarray:
        """First words of the windows whose last block may end a test string."""
        ends, end, n, before = [], self.length - 1, len(words.hash), self.block - 1
        for lo in range(before, n, _RUN):
            hi = min(n, lo + _RUN)
            if end >= hi:
                continue
            steps = self.shift[self.places(words.hash[lo - before : hi])].tobytes()
            while end < hi:
                step = steps[end - lo]
                if step:
                    end += step
                else:
                    ends.append(end)
                    end += 1
        at = np.array(ends, np.int64) - (self.length - 1)
        return at[words.text_of(at) == words.text_of(at + self.length - 1)]

    def find(self, words: Words, texts: bytes) -> Iterator[tuple[int, int]]:
        """(first word, test string) of every occurrence inside one text, by first word."""
        at = self.candidates(words)
        key = self.keys_of(words.hash, at)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = np.flatnonzero(low < high)
        for start, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
            string = words.string(start, self.length)
            for s in range(a, b):
                if texts[self.begin[s] : self.end[s]] == string:
                    yield start, s


class Tables:
    """Searchers for all windows of some items: one per window length, the words of the items kept once."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int = WINDOW):
        self.ids = ids
        words = Words([b" ".join(t.translate(_NORMAL).split()) for t in texts], Hasher())
        self.texts = words.flat
        sizes = np.diff(words.first)
        lengths = np.minimum(sizes, window)
        self.searchers = []
        for m in np.unique(lengths[lengths > 0]).tolist():
            of = np.flatnonzero(lengths == m)
            n = sizes[of] - m + 1
            item = np.repeat(of, n)
            at = np.repeat(words.first[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.searchers.append(Searcher(words, at, item, m))

    def dump(self) -> bytes:
        """As plain values, so that who reads them needs no classes of this module."""
        return pickle.dumps((self.ids, self.texts, [vars(s) for s in self.searchers]), protocol=5)

    @classmethod
    def load(cls, dumped: bytes) -> Tables:
        self = cls.__new__(cls)
        self.ids, self.texts, searchers = pickle.loads(dumped)
        self.searchers = [Searcher.__new__(Searcher) for _ in searchers]
        for tool, values in zip(self.searchers, searchers):
            vars(tool).update(values)
        return self

    @property
    def nbytes(self) -> int:
        arrays = [v for s in self.searchers for v in vars(s).values() if isinstance(v, np.ndarray)]
        return len(self.texts) + sum(a.nbytes for a in arrays)

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, start, end, numbers of the items) of every occurrence of a test string; words count from the text's first."""
        for tool in self.searchers:
            for start, s in tool.find(words, self.texts):
                text = int(words.text_of(np.int64(start)))
                at = start - int(words.first[text])
                yield text, at, at + tool.length, tool.items[tool.item_at[s] : tool.item_at[s + 1]]

    def scan(self, texts: list[bytes], hasher: Hasher) -> list[tuple[int, list[list[int]], list[str]]]:
        """Per text: number of words, merged word spans inside any occurrence, ids of the items that occur."""
        words = Words(texts, hasher)
        spans: list[set[tuple[int, int]]] = [set() for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        for text, start, end, items in self.occurrences(words):
            spans[text].add((start, end))
            found[text].update(items.tolist())
        ids = self.ids
        return [
            (n, merge(where), sorted({ids[i] for i in items if ids[i] is not None}))
            for n, where, items in zip(np.diff(words.first).tolist(), spans, found)
        ]

    def occur(self, texts: list[bytes], hasher: Hasher) -> list[bool]:
        """Per text, whether any test string occurs."""
        hit = {text for text, *_ in self.occurrences(Words(texts, hasher))}
        return [i in hit for i in range(len(texts))]


def merge(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def _groups(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """The texts in their order, in lists of about ``_GROUP`` bytes."""
    group, size = [], 0
    for text in texts:
        group.append(text or b"")
        size += len(text or b"")
        if size >= _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``block, tables``: the items' tables, made in Spark in blocks of about ``block_bytes`` and written."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text")).filter(F.length("text") > 0)
    need = F.octet_length("text") + WORD_BYTES * F.regexp_count(ascii_lower(F.col("text")), F.lit(_WORD))
    total = items.agg(F.sum(need.cast("double"))).head()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def full() -> pa.RecordBatch:
            made = Tables(ids, texts, window).dump()
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([made], pa.binary())], names=["block", "tables"])

        for batch in batches:
            for name, text, bytes_needed in zip(*(batch.column(i) for i in range(3))):
                ids.append(name.as_py())
                texts.append(text.cast(pa.binary()).as_py())
                size += bytes_needed.as_py()
                if size >= block_bytes:
                    yield full()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield full()

    parts = max(1, math.ceil(total / block_bytes))
    rows = items.select("id", "text", need.cast("long").alias("need")).repartition(parts)
    return materialize(rows.mapInArrow(run, "block long, tables binary"), "decontaminate-blocks")


def _shipped(blocks: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """A broadcast of each block's tables, and whether it is the only one.  The driver holds one block at a time."""
    numbers = [r.block for r in blocks.select("block").collect()]
    for number in sorted(numbers):
        tables = blocks.filter(F.col("block") == number).head().tables
        yield blocks.sparkSession.sparkContext.broadcast(bytes(tables)), len(numbers) == 1


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())),
])


def _search(docs: DataFrame, block: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hasher = Tables.load(block.value), Hasher()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text").cast(pa.binary()))
            rows = [row for group in _groups(texts) for row in tables.scan(group, hasher)]
            columns = [list(c) for c in zip(*rows)] or [[], [], []]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), *columns], schema=_SCHEMA)

    return docs.mapInArrow(
        run, "doc_id long, text_hash long, n_words long, spans array<array<long>>, items array<string>"
    )


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, items`` per document: merged hit spans in words, item ids sorted."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty(F.col("text"))).alias("text_hash"), "text"
    )
    passes = []
    for block, only in _shipped(_blocks(benchmark, window, block_bytes)):
        found = _search(rows, block)
        if only:
            return found
        passes.append(materialize(found, "decontaminate-pass"))
        block.destroy()
    if not passes:
        return _search(rows, docs.sparkSession.sparkContext.broadcast(Tables([], [], window).dump()))
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("doc_id", "text_hash").agg(
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<array<bigint>>)"),
        lambda done, span: F.when(
            (F.size(done) > 0) & (span[0] <= F.element_at(done, -1)[1]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], span[1]))),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    return merged.withColumn("spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop(
        "copy", "copies"
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_benchmark(docs, benchmark, window, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, all their columns kept."""
    hits = []
    for block, only in _shipped(_blocks(benchmark, window, block_bytes)):
        if only:
            return docs.filter(~_occurs(block)(F.col("text")))
        held = docs.filter(_occurs(block)(F.col("text"))).select(F.sha2("text", 256).alias("_dc_text"))
        hits.append(materialize(held.distinct(), "decontaminate-hits"))
        block.destroy()
    if not hits:
        return docs
    every = hits[0]
    for other in hits[1:]:
        every = every.unionByName(other)
    every = every.distinct()
    return docs.join(every, F.sha2(text_or_empty(docs["text"]), 256) == every["_dc_text"], "left_anti")


def _occurs(block: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables, hasher = Tables.load(block.value), Hasher()
        for batch in batches:
            texts = (t.as_py() for t in batch.cast(pa.binary()))
            found = [hit for group in _groups(texts) for hit in tables.occur(group, hasher)]
            yield pa.array(found, pa.bool_())

    return run


by_value(__name__)
