"""Packing, fill-in-the-middle and the filter audit against brute force, and their odd inputs."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_data import sf_mid  # noqa: F401
from stargraph.llm import filter_audit, infill, packing, queries
from test_operators import DOCS, EVERY, ODD, ids, odd  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# ── Packing ──────────────────────────────────────────────────────────────────────────────────────────────
def brute_difference(sizes, k):
    """Multiway differencing on whole tuples, zeros included."""
    made = itertools.count()
    heap = [(-s, next(made), [(0, [])] * (k - 1) + [(s, [i])]) for i, s in enumerate(sizes)]
    while len(heap) > 1:
        heap.sort(key=lambda x: x[:2])
        (_, _, a), (_, _, b) = heap[:2]
        joined = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))], key=lambda x: x[0])
        heap = [*heap[2:], (joined[0][0] - joined[-1][0], len(sizes) + next(made), joined)]
    return [s for s, _ in heap[0][2]]


def test_difference_is_a_partition_with_the_sums_of_plain_differencing():
    rng = random.Random(3)
    for _ in range(60):
        k = rng.randint(1, 6)
        sizes = [rng.randint(1, 2000) for _ in range(rng.randint(1, 24))]
        groups = packing.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= k
        spread = sorted([0] * (k - len(groups)) + [sum(sizes[i] for i in g) for g in groups])
        plain = brute_difference(sizes, k)
        assert spread == sorted(plain)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.difference([], 3) == []


def test_windows_are_full_before_the_last_block():
    rng = random.Random(4)
    pieces = [(i, 0, rng.randint(1, 99)) for i in range(400)]
    filled, over = packing.windows_of(pieces, 100, False)
    assert {sum(p[2] for p in g) for g in filled} == {100} and sum(p[2] for p in over) < 100
    filled, over = packing.windows_of(pieces, 100, True)
    sizes = [sum(p[2] for p in g) for g in filled]
    assert not over and max(sizes) <= 100 and len(sizes) == -(-sum(p[2] for p in pieces) // 100)


def check_packed(rows, texts, tokenizer, window):
    """Every id of every document lies in one piece; sequences have no gap; only some sequences are short."""
    want = collections.Counter()
    for doc, text in texts:
        want[doc, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(got) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, got))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    left = want.copy()
    for (doc, n), pieces in docs.items():
        copies = sum(c for (d, i), c in want.items() if d == doc and len(i) == n)
        covered = collections.Counter()
        for start, got in pieces:
            whole = [i for (d, i) in want if d == doc and len(i) == n and list(i[start : start + len(got)]) == got]
            assert whole
            covered.update(range(start, start + len(got)))
        assert set(covered) == set(range(n)) and set(covered.values()) == {copies}
        for key in [key for key in left if key[0] == doc and len(key[1]) == n]:
            del left[key]
    assert not left
    return [sum(n for _, n in spans) for spans in sequences.values()]


def test_pack_odd_rows(spark, odd, tokenizer):
    rows = packing.pack(packing.tokenize(odd.coalesce(1), PATH), window=64, block=1024).collect()
    sizes = check_packed(rows, [(r[0], r[1]) for r in ODD], tokenizer, 64)
    assert sum(64 - s for s in sizes) < 64
    assert packing.report(odd.limit(0), PATH).count() == 0
    assert packing.report(odd, PATH).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    ]


@given(st.lists(st.text(alphabet="aB 'é\n\t\x0b\x85 ́İΣ9.<|endoftext>中🙂", max_size=40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_whole_text(texts):
    words = test_ids_are_those_of_the_whole_text.words
    texts += ["don't STOP", "x<|endoftext|>y z<|ENDOFTEXT|>", ""]
    flat, sizes = words.encode(pa.array(texts, pa.string()), 1)
    want = [i for t in texts for i in [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert flat.tolist() == want and sizes.sum() == len(want)


test_ids_are_those_of_the_whole_text.words = packing.Words(PATH)


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.Words(path), Tokenizer.from_file(path)
    texts = ["two  words", "", " a\n"]
    ids, sizes = words.encode(pa.array(texts), 7)
    assert not words.by_word and packing.Words(PATH).by_word
    assert ids.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 7]] and len(sizes) == 3


def test_forgotten_words_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 2)
    words = packing.Words(PATH)
    for text in ["a b c d", "d c b a", "e"]:
        assert words.encode(pa.array([text]), 1)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_atoms_of_a_whole_array_of_words():
    """Words are cut as arrays, not one by one (op11_packing: CPU seconds a GB)."""
    words = ["word", "Word.", "(WORD),", "...", "", "don't", "é.", "É", "İ.", "a<|endoftext|>", "x1", "--ünder--", "'s", "a.b."]
    want = [("", "word", ""), ("", "word", "."), ("(", "word", "),"), ("", "...", ""), ("", "", ""), ("", "don't", ""), ("", "é", "."),
            ("", "É", ""), ("", "İ.", ""), ("", "a<|endoftext|>", ""), ("", "x1", ""), ("--", "ünder", "--"), ("", "'s", ""),
            ("", "a.b.", "")]
    both = pa.array(["unused.", *words], pa.string())[1:]  # an array with an offset
    assert [*zip(*(part.to_pylist() for part in packing._atoms(both)))] == want
    assert [part.to_pylist() for part in packing._atoms(both[:0])] == [[], [], []]
    coder = packing.Words(PATH)
    ids, ends = coder.coded(both)
    for word, a, b in zip(words, ends, ends[1:]):
        assert ids[a:b].tolist() == coder.tokenizer.encode(word, add_special_tokens=False).ids
    known = len(coder.number)
    coder.coded(pa.array(["WORD--", "..."]))
    assert len(coder.number) == known  # nothing is encoded a second time


def test_packing_query(spark, sf_mid, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect()]
    found = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = packing.pack(packing.tokenize(found, PATH)).collect()
    sizes = check_packed(rows, docs, tokenizer, packing.WINDOW)
    assert sum(packing.WINDOW - s for s in sizes) < packing.WINDOW * found.rdd.getNumPartitions()
    report = {(r.doc_id, r.start): r for r in queries.op11_packing(spark, sf_mid).collect()}
    assert {k: (r.length, r.ids_crc32) for k, r in report.items()} == {
        (r.doc_id, r.start): (r.length, zlib.crc32(bytes(r.ids))) for r in rows
    }


# ── Fill in the middle ───────────────────────────────────────────────────────────────────────────────────
UNITS = regex.compile(f"({infill.CODE_POINT})*")
TEXTS = st.text(alphabet="a<PSM>\n é🙂", max_size=30)


@given(TEXTS, st.integers(0, 10_000))
@settings(max_examples=300, deadline=None)
def test_infill_matches_brute_force(text, doc):
    made = infill.transform(text, doc, UNITS)
    h = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    plain = not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>"))
    want = text if plain else (
        "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b] if h4 % 100 < 20
        else "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    )
    assert made.n == n and made.output == want and infill.restore(made.output, made.form) == text
    assert (made.form == "plain") == plain and (made.prefix_chars, made.middle_chars) == ((None, None) if plain else (a, b - a))


def test_infill_units_other_than_code_points():
    words = regex.compile(r"(\s*\S+|\s+)*")
    for doc in range(40):
        made = infill.transform("one two  three four \n", doc, words)
        assert made.n == 5 and infill.restore(made.output, made.form) == "one two  three four \n"
        if made.form != "plain":
            assert made.prefix_chars in (0, 3, 7, 14, 19, 21)


def test_infill_odd_rows(spark, odd):
    out = infill.fill_in_middle(odd)
    assert ids(out) == EVERY
    want = collections.Counter((r[0], r[1] or "") for r in ODD)
    assert collections.Counter((r.doc_id, r.restored) for r in out.collect()) == want
    assert {r.form for r in out.filter("doc_id in (2, 3)").collect()} == {"plain"}
    assert infill.report(odd.limit(0)).count() == 0


# ── Filter audit ─────────────────────────────────────────────────────────────────────────────────────────
def brute_audit(docs, labels):
    """Every document through every order, one at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    fails = []
    for d, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and d > first[text],
        })
    out = {}
    for part in {x or "" for *_, x in docs}:
        mine = [(d, f) for (d, _, x), f in zip(docs, fails) if (x or "") == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            there = list(mine)
            for step, f in enumerate(order, 1):
                gone = [m for m in there if m[1][f]]
                kept = [m for m in there if not m[1][f]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(kept), len(gone), sum(m[1][f] for m in mine) - len(gone),
                    sum(m[1][f] and sum(m[1].values()) == 1 for m in mine),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone),
                ]
                there = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in rows
    }


def test_audit_matches_brute_force(spark):
    rng = random.Random(6)
    words = ["Wort", "ein", "A$", "zwei\x0b", "é", "DREI", "b\xa0c", "d\x85"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, m)) for _ in range(n)) for m in (5, 10_000) for n in (3, 99, 100, 140)]
    texts += ["", None, "ABC", "x" * 30, " ".join(f"w{i}" for i in range(120))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "de", "en"])) for _ in range(150)]
    docs += [docs[0], docs[1]]
    labels = [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(7))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    assert audited(filter_audit.report(frame, marks)) == brute_audit(docs, labels)
    assert audited(filter_audit.report(frame, marks.limit(0))) == brute_audit(docs, [])


def test_audit_odd_and_empty(spark, odd, sf_mid):
    labels = spark.read.parquet(f"{sf_mid}/labels.parquet")
    got = audited(filter_audit.report(odd, labels))
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert got == brute_audit([(r[0], r[1], r[2]) for r in ODD], marks)
    assert filter_audit.report(odd.limit(0), labels).count() == 0


def test_audit_plan_is_native(spark, sf_mid):
    plan = queries.op13_filter_audit(spark, sf_mid)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan
