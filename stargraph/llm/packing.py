"""Packing of tokenized documents into sequences of one window length (Karmarkar-Karp multiway differencing).

``tokenize`` turns texts into token ids; ``pack`` places every id in a sequence of at most ``window`` ids.  Both run
where the rows are: no shuffle, nothing on the driver.

A document longer than the window gives whole windows, which are sequences of their own, and a rest shorter than one.
The rests of a task are gathered into blocks of about ``block`` ids.  A block is divided into windows by multiway
differencing: each rest is a partial partition with one filled window; the two partitions of the largest imbalance are
merged again and again, the fullest window of the one with the emptiest of the other, until one partition of
near-equal windows is left.  Their number is the block's size over the window; it rises by one when that capacity is
exceeded at the end of the task, before that the rest is handed to the next block.  What differencing leaves over the
window is cut off and fills the windows below it.  So only the windows of a task's last block need padding, less than
one window of it in all.

Cases: a null text is an empty one; an empty text has the end id alone; repeated rows are packed each; a null doc_id is
carried like any other; of other columns none is used, whatever their names; an empty table gives no pieces.  A text of
any length is tokenized and cut whole.  A task holds one block and one batch of rows at a time, so tasks that are run
again after a lost executor give the same pieces as long as the rows come in the same order (files do).
"""
from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import partial
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stargraph.llm.common import by_value, text_or_empty

by_value(__name__)

WINDOW = 2048
BLOCK = 1 << 21       # ids of a block: about a thousand windows
LUMP = 64             # shorter rests are laid together first, so that a block has at most BLOCK / LUMP partitions
END_ID = 1
KNOWN_WORDS = 1 << 19  # atoms of words whose ids a task remembers
ENCODE = 4096         # atoms encoded at a time
ROW = 64              # words of letters encoded as one text
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")  # an apostrophe may start an ending
SLICE = 4 << 20       # bytes of text tokenized at a time
EMIT = 8 << 20        # bytes of ids in a batch of pieces


# ── Tokens ───────────────────────────────────────────────────────────────────────────────────────────────
class Words:
    """Ids of texts.

    Where the tokenizer drops white space and marks the ends of words in its tokens, no token reaches over white space:
    each distinct word of a slice is looked up once.  Marks around a word of letters are tokens of their own there, so a
    word is marks, letters and marks (``_atoms``), the letters in ASCII without capitals: these atoms are encoded once
    and known after that.  Atoms of letters are encoded many in a row, as the marked ends tell them apart.  Words are
    cut, looked up and put together as whole arrays.  Texts go to any other tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        end = json.loads(t.to_str())["model"].get("end_of_word_suffix")
        probes = self.whole(["a", "b", "a  b", " \t\n\x0b\f\r", "(a.", "(", ".", "B"]) if end else []
        self.by_word = bool(end) and probes[2:5] + probes[7:] == [
            probes[0] + probes[1], [], probes[5] + probes[0] + probes[6], probes[1]
        ]
        if self.by_word:
            self.ends_word = np.array([(t.id_to_token(i) or "").endswith(end) for i in range(t.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)  # the empty atom has no ids

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, atoms: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(atoms, range(len(self.number), len(self.number) + len(atoms))))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def learn(self, atoms: list[str]) -> None:
        """Ids of unknown atoms."""
        letters, others = [], []
        for a in atoms:
            (letters if a.isalpha() and (a.isascii() or is_normalized("NFC", a)) else others).append(a)
        for i in range(0, len(letters), ENCODE):
            run = letters[i : i + ENCODE]
            coded = self.whole([" ".join(run[j : j + ROW]) for j in range(0, len(run), ROW)])
            ids, row_sizes = _joined(coded)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            upto = np.cumsum(row_sizes)
            found = np.diff(np.searchsorted(ends, upto, "right"), prepend=0)
            wanted = np.minimum(ROW, len(run) - ROW * np.arange(len(coded)))
            closed = (row_sizes > 0) & self.ends_word[ids[upto - 1]] if len(ids) else row_sizes > 0
            good = (found == wanted) & closed
            if not good.all():  # letters that the tokenizer does not know as such
                others += [a for r in np.flatnonzero(~good).tolist() for a in run[r * ROW : (r + 1) * ROW]]
                run = [a for r in np.flatnonzero(good).tolist() for a in run[r * ROW : (r + 1) * ROW]]
                ids = ids[np.repeat(good, row_sizes)]
                ends = np.flatnonzero(self.ends_word[ids]) + 1
            self._add(run, ids, np.diff(ends, prepend=0))
        for i in range(0, len(others), ENCODE):
            run = others[i : i + ENCODE]
            self._add(run, *_joined(self.whole(run)))

    def coded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words in a row, and where each ends; unknown atoms are encoded first."""
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        atoms = pa.chunked_array(_atoms(words)).dictionary_encode().combine_chunks()
        texts = atoms.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([a for a in texts if a not in self.number])
        number = np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))
        at = number[atoms.indices.to_numpy(zero_copy_only=False)].reshape(3, len(words)).T.ravel()
        ids, ends = _gather(self.flat, self.ends, at)
        return ids, ends[::3]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, an end id after each text, and the number of ids of each text."""
        if not self.by_word:
            return _joined([[*ids, end_id] for ids in self.whole(texts.to_pylist())])
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        flat, ends = self.coded(words.dictionary.cast(pa.string()))
        # the end id is one more word, after each text
        flat, ends = np.append(flat, np.uint32(end_id)), np.append(ends, ends[-1] + 1)
        last = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        at = np.insert(words.indices.to_numpy(zero_copy_only=False), last, len(ends) - 2)
        ids, upto = _gather(flat, ends, at)
        return ids, np.diff(upto[last + np.arange(1, len(last) + 1)], prepend=0)


def _joined(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and their sizes."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[ends[i]:ends[i + 1]]`` of the numbers ``at`` in a row, and where each ends (after a zero)."""
    starts, sizes = ends[at], np.diff(ends)[at]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)], upto


def _atoms(words: pa.StringArray) -> list[pa.StringArray]:
    """Marks, letters, marks of each word, empty where it has none; or the word itself between two empty texts (a
    special token in it must stay whole)."""
    core = pc.utf8_trim(words, characters=MARKS)
    size, core_size = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, core))
    lead = size - pc.binary_length(pc.utf8_ltrim(words, characters=MARKS)).to_numpy(zero_copy_only=False)
    split = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (core_size > 0)
    split &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    ascii_ = pc.string_is_ascii(core).to_numpy(zero_copy_only=False)
    wide = np.flatnonzero(split & ~ascii_)
    split[wide] = [c.isalpha() and c.lower().isalpha() for c in core.take(pa.array(wide)).to_numpy(zero_copy_only=False)]
    middle = pc.if_else(pa.array(split & ascii_), pc.ascii_lower(core), pc.if_else(pa.array(split), core, words))
    after = np.where(split, lead + core_size, 0)
    return [_between(words, np.zeros_like(size), np.where(split, lead, 0)), middle,
            _between(words, after, np.where(split, size - after, 0))]


def _between(words: pa.StringArray, skip: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """``size`` bytes of each word after its first ``skip``."""
    _, offsets, data = words.buffers()
    if not size.any():
        return pa.array([""] * len(words), pa.string())
    starts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words)] + skip
    upto = np.concatenate([[0], np.cumsum(size)])
    cut = np.frombuffer(data, np.uint8)[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(cut))


def _slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes in a column, one row at least."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    which = (np.cumsum(lengths) - lengths) // size
    bounds = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(lengths)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: the ids of each text with ``end_id`` after them, as little-endian unsigned 32-bit numbers.

    ``path`` names a tokenizer file that every executor can open.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    return _texts(docs).mapInArrow(partial(_tokens, path=path, end_id=end_id), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    words = Words(path)
    for batch in batches:
        for part in _slices(batch, 1, SLICE):
            ids, sizes = words.encode(part.column(1), end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes * 4)])
            binary = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays([part.column(0), binary.cast(pa.binary())], ["doc_id", "ids"])


# ── Windows ──────────────────────────────────────────────────────────────────────────────────────────────
def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The numbers of the sizes in each of at most ``k`` windows, by multiway differencing.

    A partial partition is its filled windows, ascending; the others are empty.  Equal imbalances merge in the order
    in which the partitions were made.
    """
    n = len(sizes)
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made, nodes, left, right = n, n, [], []
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        free = k - len(a)  # empty windows of the first: they take the fullest of the second
        both = max(len(b) - free, 0)
        joined = np.arange(nodes, nodes + both)
        nodes += both
        left.append(x[:both])
        right.append(y[len(b) - both :])
        total = np.concatenate([a[:both] + b[len(b) - both :], a[both:], b[: len(b) - both]])
        which = np.concatenate([joined, x[both:], y[: len(b) - both]])
        order = np.argsort(total, kind="stable")
        total, which = total[order], which[order]
        imbalance = int(total[-1] - (total[0] if len(total) == k else 0))
        heapq.heappush(heap, (-imbalance, made, total, which))
        made += 1
    window = np.empty(nodes, np.int64)
    windows: list[list[int]] = []
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
        windows = [[] for _ in heap[0][3]]
    pairs = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist())) if left else []
    for node in range(nodes - 1, n - 1, -1):
        a, b = pairs[node - n]
        window[a] = window[b] = window[node]
    for i, w in enumerate(window[:n].tolist()):
        windows[w].append(i)
    return windows


Piece = tuple[int, int, int]  # number of the document, first id, number of ids


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of some pieces, and what is left."""
    for i, (doc, start, length) in enumerate(pieces):
        if length > size:
            head = [(doc, start, size)] if size else []
            return pieces[:i] + head, [(doc, start + size, length - size), *pieces[i + 1 :]]
        size -= length
    return pieces, []


def windows_of(pieces: list[Piece], window: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of at most ``window`` ids, and the pieces that wait for the next block (none if it is the last)."""
    lumps: list[list[Piece]] = []
    size = LUMP
    for piece in pieces:
        if size >= LUMP or size + piece[2] > window:
            lumps.append([])
            size = 0
        lumps[-1].append(piece)
        size += piece[2]
    total = sum(p[2] for p in pieces)
    k = total // window
    if last and total > k * window:
        k += 1  # the capacity is exceeded
    if not k:
        return [], pieces
    filled, over = [], []
    for group in difference([sum(p[2] for p in lump) for lump in lumps], k):
        kept, more = _cut([p for i in group for p in lumps[i]], window)
        filled.append(kept)
        over += more
    for group in filled:
        if not over:
            break
        room = window - sum(p[2] for p in group)
        if room:
            more, over = _cut(over, room)
            group += more
    return filled, over


def pack(tokens: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of ``doc_id, ids`` (``tokenize``).

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; a sequence has no gap.
    ``sequence_id`` is unique over all tasks.  A sequence shorter than ``window`` is to be padded.
    """
    return tokens.select("doc_id", "ids").mapInArrow(partial(_pieces, window=window, block=block), _schema(tokens))


def pack_texts(docs: DataFrame, path: str, window: int = WINDOW, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """``pack`` of ``tokenize``, in one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(_tokens(batches, path, end_id), window, block)

    return _texts(docs).mapInArrow(run, _schema(docs))


def _schema(df: DataFrame) -> T.StructType:
    longs = {name: T.StructField(name, T.LongType()) for name in ("start", "length", "doc_tokens", "sequence_id", "offset")}
    ids = T.StructField("ids", T.BinaryType())
    return T.StructType([
        T.StructField("doc_id", df.schema["doc_id"].dataType), longs["start"], longs["length"], ids, longs["doc_tokens"],
        longs["sequence_id"], longs["offset"],
    ])


class _Sequences:
    """Rows of finished sequences, handed out in batches of about ``EMIT`` bytes of ids."""

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def __init__(self, first: int):
        self.number, self.rows, self.size, self.key = first, [], 0, pa.null()

    def place(self, group: list[Piece], docs: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        at = 0
        for doc, start, length in group:
            doc_id, ids = docs[doc]
            self.rows.append((doc_id, start, length, ids[start * 4 : (start + length) * 4], len(ids) // 4, self.number, at))
            at += length
        self.number += 1
        self.size += at * 4
        if self.size >= EMIT:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*self.rows), [self.key, *self.kinds])]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(arrays, self.names)


def _pieces(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    out = _Sequences(TaskContext.get().partitionId() << 33)
    docs: dict[int, tuple] = {}  # number: doc_id, ids of the documents with a waiting piece
    waiting: list[Piece] = []
    seen = held = 0
    for batch in batches:
        out.key = batch.schema.field(0).type
        for doc_id, ids in zip(batch.column(0), batch.column(1)):
            doc_id, ids = doc_id.as_py(), ids.as_py()
            whole, rest = divmod(len(ids) // 4, window)
            docs[seen] = (doc_id, ids)
            for i in range(whole):
                yield from out.place([(seen, i * window, window)], docs)
            if rest:
                waiting.append((seen, whole * window, rest))
                held += rest
            else:
                del docs[seen]
            seen += 1
            if held >= block:
                groups, waiting = windows_of(waiting, window, False)
                for group in groups:
                    yield from out.place(group, docs)
                held = sum(p[2] for p in waiting)
                docs = {p[0]: docs[p[0]] for p in waiting}
    for group in windows_of(waiting, window, True)[0]:
        yield from out.place(group, docs)
    yield from out.rest()


def report(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece with the checksum of its ids."""
    return pack_texts(docs, path, window).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
