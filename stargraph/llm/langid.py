"""Language identification by cross-parsing entropy.

Learning: per language, a bounded sample of labelled text (``SAMPLE_DOCS`` distinct slices in a fixed pseudo-random
order, the first ``PER_DOC`` characters of each and ``SAMPLE_CHARS`` together, so about 20 whole slices) becomes a
suffix automaton, which accepts exactly the substrings of the sample.  Prediction: a text is cut greedily into phrases,
each the longest match in the sample; the number of phrases times log2(sample length) per symbol estimates
the cross entropy, and the language with the fewest normalised phrases wins (ties: the smallest language code).

Symbols are all letters of the samples with case folded; every run of other characters is one blank, a letter that the
sample lacks belongs to the phrase that it ends.  Texts are parsed in whole, in lanes of ``LANE`` symbols that are
stepped together with numpy and joined where the parses of two lanes meet, so the count is that of an unbroken parse.

``score`` is the margin (b - a) / (b + a) of the best a and second best b cross entropies, 1.0 if only one
language was learned.  Text null, empty or without a letter: ``und`` with score 0.0; the same if no language was
learned.  Null ids and repeated rows stay rows; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stargraph.llm.common import by_value

SAMPLE_CHARS = 12_000
SAMPLE_DOCS = 64
PER_DOC = 600
LANE = 512
_PIECE = 1 << 20  # characters that are parsed together
_ROOM = 3  # slots per transition of the packed tables


def learn_samples(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, per_doc: int = PER_DOC) -> dict[str, list[str]]:
    """A bounded number of text slices per language from ``text, lang`` rows.

    Slices are taken in the order of their hash, those of short texts last.  Counts per language say up to which hash
    about ``4 * sample_docs`` slices lie, so only those are ranked; where they prove too few, all of that language are.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", (F.length("text") < 100).alias("late"), F.substring("text", 1, per_doc).alias("slice")
    )
    rows = rows.withColumn("at", F.xxhash64("slice"))
    counts = rows.groupBy("lang", "late").agg(F.approx_count_distinct("at").alias("n")).collect()
    share = {(r.lang, r.late): min(1.0, 4 * sample_docs / max(1, r.n)) for r in counts}
    samples = _lowest(rows, share, sample_docs)
    short = {lang for lang, late in share if len(samples.get(lang, ())) < sample_docs and share[lang, late] < 1}
    if short:
        samples.update(_lowest(rows, {key: 1.0 for key in share if key[0] in short}, sample_docs))
    return samples


def _lowest(rows: DataFrame, share: dict[tuple[str, bool], float], sample_docs: int) -> dict[str, list[str]]:
    """The first ``sample_docs`` distinct slices per language; a share of the hashes is looked at."""
    until = {f"{int(late)}{lang}": min(2**63 - 1, int(part * 2**64) - 2**63) for (lang, late), part in share.items()}
    limits = F.from_json(F.lit(json.dumps(until)), "map<string,bigint>")  # one literal, two numbers a language
    chosen = (
        rows.filter(F.col("at") <= F.element_at(limits, F.concat(F.col("late").cast("int").cast("string"), F.col("lang"))))
        .groupBy("lang", "late", "at", "slice")  # copies take one place
        .agg(F.lit(1).alias("one"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("late", "at", "slice")))
        .filter(F.col("place") <= sample_docs)
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen, key=lambda r: (r.lang, r.place)):
        samples.setdefault(row.lang, []).append(row.slice)
    return samples


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions per state of the smallest automaton of all substrings; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


def fold(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def pack(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, owner, to``: state s goes by symbol c to ``to[base[s] + c]`` if ``owner[base[s] + c] == base[s]``.

    The rows of the states lie over one another, each at a base of its own where its transitions find free slots, so
    the table grows with the transitions and not with states times symbols.
    """
    room = _ROOM * sum(map(len, states)) + len(states)
    rng = random.Random(room)
    owner, used = [-1] * (room + width), bytearray(room)
    base = np.zeros(len(states), dtype=np.int32)
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        at = int(rng.random() * room)
        while used[at] or any(owner[at + c] >= 0 for c in states[s]):
            at = int(rng.random() * room)
        used[at], base[s] = 1, at
        for c in states[s]:
            owner[at + c] = at
    to = np.zeros(room + width, dtype=np.int32)
    for s, edges in enumerate(states):
        for c, t in edges.items():
            to[base[s] + c] = base[t]
    return base, np.array(owner, dtype=np.int32), to


class Model:
    """Per language the automaton as a packed table (see ``pack``) over shared symbols, all end to end.

    ``first`` holds per language and symbol the state that the symbol reaches from the start, where the next phrase
    begins.  ``symbol_of`` maps code points to symbols (0 blank, 1 a letter that no sample has).
    """

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS):
        self.languages = sorted(samples)
        texts = {lang: " ".join(samples[lang])[:sample_chars] for lang in self.languages}
        letters = sorted({fold(c) for text in texts.values() for c in set(text) if c.isalpha()})
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        self.symbol_of = np.array(
            [number.get(fold(c), 1) if c.isalpha() else 0 for c in map(chr, range(0x110000))],
            dtype=np.min_scalar_type(self.width),
        )
        rows, owners, tos = 0, [], []
        self.starts, self.bits = [], []
        self.first = np.zeros((len(self.languages), self.width), dtype=np.int32)
        for i, lang in enumerate(self.languages):
            symbols, _ = self.symbols([texts[lang]])
            states = suffix_automaton(symbols.tolist())
            base, owner, to = pack(states, self.width)
            self.first[i] = rows + base[0]
            for c, t in states[0].items():
                self.first[i, c] = rows + base[t]
            owners.append(np.where(owner >= 0, owner + rows, -1).astype(np.int32))
            tos.append(to + np.int32(rows))
            self.starts.append(rows + int(base[0]))
            self.bits.append(np.log2(max(2, len(symbols))))
            rows += len(owner)
        self.owner, self.to = (np.concatenate([np.zeros(0, dtype=np.int32), *parts]) for parts in (owners, tos))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols end to end, runs of blanks as one, and the number of symbols of each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.symbol_of[codes]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0) | (owner[1:] != owner[:-1])
        return out[keep], np.bincount(owner[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (languages x texts), symbols and letters per text."""
        symbols, sizes = self.symbols(texts)
        ends = np.cumsum(sizes)
        letters = np.concatenate(([0], np.cumsum(symbols != 0)))
        roots = np.repeat(np.array(self.starts, dtype=np.int32)[:, None], len(texts), axis=1)
        return self.parse(symbols, sizes, roots)[0], sizes, letters[ends] - letters[ends - sizes]

    def long(self, text: str) -> tuple[np.ndarray, int, int]:
        """``phrases`` of one text of any length, in parts that go on in the state that the one before left."""
        state = np.array(self.starts, dtype=np.int32)[:, None]
        total, size, letters, blank = np.zeros(len(state)), 0, 0, False
        for cut in range(0, len(text), _PIECE):
            symbols, _ = self.symbols([text[cut : cut + _PIECE]])
            if blank and len(symbols) and symbols[0] == 0:
                symbols = symbols[1:]
            if not len(symbols):
                continue
            blank = symbols[-1] == 0
            part, state = self.parse(symbols, np.array([len(symbols)]), state)
            total += part[:, 0]
            size, letters = size + len(symbols), letters + int((symbols != 0).sum())
        return total, size, letters

    def parse(self, symbols: np.ndarray, sizes: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended (languages x texts) of texts that begin in the states ``enter``, and the states at their ends.

        Lanes are stepped together as if each began a phrase.  Then each is run again from the state in which the lane
        before it ended, beside the first run, until both are in one state: from there on they agree.
        """
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        ends = np.cumsum(sizes)
        start = np.repeat(ends - sizes, lanes) + nth * LANE
        length = np.minimum(LANE, np.repeat(ends, lanes) - start)
        fresh = np.where(nth == 0, enter.take(owner, axis=1), np.array(self.starts, dtype=np.int32)[:, None])
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        state, count = fresh.take(order, axis=1), np.zeros(fresh.shape, dtype=np.int32)
        for step, k in enumerate(live.tolist()):
            symbol = symbols[start[order[:k]] + step]
            now = state[:, :k]
            cell = now + symbol
            goes_on = self.owner.take(cell) == now
            count[:, :k] += ~goes_on
            state[:, :k] = np.where(goes_on, self.to.take(cell), self.first.take(symbol, axis=1))
        back = np.argsort(order)
        state, count = state.take(back, axis=1), count.take(back, axis=1)
        self._join(symbols, start, length, nth, fresh, state, count)
        total = [np.bincount(owner, weights=row, minlength=len(sizes)) for row in count]
        final = enter.copy()
        final[:, sizes > 0] = state[:, np.cumsum(lanes)[sizes > 0] - 1]
        return np.stack(total), final

    def _join(self, symbols, start, length, nth, fresh, state, count) -> None:
        """Correct the lanes' counts and end states for the states in which they are entered."""
        later = np.flatnonzero(nth > 0)
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(state)), later, indexing="ij"))
        one, two = state[lang, lane - 1], fresh[lang, lane]
        entered, open_ = state.copy(), []
        for step in range(LANE):
            differ = one != two
            over = differ & (length[lane] <= step)
            open_ += zip(lane[over].tolist(), lang[over].tolist(), one[over].tolist())
            keep = differ & ~over
            lang, lane, one, two = lang[keep], lane[keep], one[keep], two[keep]
            if not len(lane):
                break
            symbol = symbols[start[lane] + step]
            begin = self.first[lang, symbol]
            ends = []
            for now in (one, two):
                goes_on = self.owner[now + symbol] == now
                ends.append((np.where(goes_on, self.to[now + symbol], begin), ~goes_on))
            (one, a), (two, b) = ends
            np.add.at(count, (lang, lane), a.astype(np.int32) - b)
        differ = one != two
        open_ += zip(lane[differ].tolist(), lang[differ].tolist(), one[differ].tolist())
        # lanes that were left in another state than the first run's: their followers were entered in a wrong one
        done: set[tuple[int, int]] = set()
        for lane, lang, now in sorted(open_):
            if (lang, lane) not in done:
                state[lang, lane] = now
                done |= self._follow(symbols, start, length, nth, fresh, state, entered, count, lang, lane)

    def _follow(self, symbols, start, length, nth, fresh, state, entered, count, lang, lane) -> set[tuple[int, int]]:
        """Go on from a lane that ended in another state than its first run, lane by lane, until one ends as that did."""
        go, to, first = memoryview(self.owner), memoryview(self.to), self.first[lang].tolist()

        def run(s: int, lane: int, other: int | None) -> tuple[int, int]:
            """The end state and the phrases ended from ``s``, less those from ``other`` until both are in one state."""
            n = 0
            for c in symbols[start[lane] : start[lane] + length[lane]].tolist():
                if s == other:
                    return -1, n
                if go[s + c] == s:
                    s = to[s + c]
                else:
                    s, n = first[c], n + 1
                if go[other + c] == other:
                    other = to[other + c]
                else:
                    other, n = first[c], n - 1
            return (-1 if s == other else s), n

        done = set()
        while lane + 1 < len(start) and nth[lane + 1] and state[lang, lane] != entered[lang, lane]:
            before, after = int(entered[lang, lane]), int(state[lang, lane])
            lane += 1
            root, end = int(fresh[lang, lane]), int(entered[lang, lane])
            _, wrong = run(before, lane, root)
            last, right = run(after, lane, root)
            count[lang, lane] += right - wrong
            state[lang, lane] = end if last < 0 else last
            done.add((lang, lane))
        return done

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(self.languages), len(texts)))
        sizes, letters = np.zeros(len(texts)), np.zeros(len(texts))
        for at, piece in _pieces(texts):
            if len(at) > 1:
                total[:, at], sizes[at], letters[at] = self.phrases(piece)
            else:
                total[:, at[0]], sizes[at], letters[at] = self.long(piece[0])
        entropy = total * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        names, scores = [], []
        for i in range(len(texts)):
            column = entropy[:, i]
            best = int(np.argmin(column))
            if not letters[i]:
                names.append("und")
                scores.append(0.0)
                continue
            a, b = column[best], np.delete(column, best).min(initial=np.inf)
            names.append(self.languages[best])
            scores.append(1.0 if b == np.inf else float((b - a) / (b + a)) if b > 0 else 0.0)
        return names, scores


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts in groups of about ``_PIECE`` characters."""
    at, group, size = [], [], 0
    for i, text in enumerate(texts):
        at.append(i)
        group.append(text)
        size += len(text)
        if size >= _PIECE or (i + 1 < len(texts) and size + len(texts[i + 1]) > 2 * _PIECE):
            yield at, group
            at, group, size = [], [], 0
    if group:
        yield at, group


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per document, from its text alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            names, scores = model.predict(texts)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), names, scores], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


by_value(__name__)
