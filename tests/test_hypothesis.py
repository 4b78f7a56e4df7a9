"""Randomised checks of the exactness-critical operators against brute force (Hypothesis)."""
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stargraph.operators import copurchase as C
from stargraph.operators import reviews as R

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

incidences = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40)), min_size=1, max_size=120)


def _brute(rows, min_weight):
    by_g = {}
    for g, i in rows:
        by_g.setdefault(g, set()).add(i)
    counts = {}
    for items in by_g.values():
        for a, b in itertools.combinations(sorted(items), 2):
            counts[(a, b)] = counts.get((a, b), 0) + 1
    return sorted((a, b, w) for (a, b), w in counts.items() if w >= min_weight)


@SETTINGS
@given(rows=incidences, block=st.integers(1, 12), min_weight=st.integers(1, 3))
def test_pair_counts_exact(spark, rows, block, min_weight):
    inc = spark.createDataFrame(rows, "g long, item long").distinct()
    got = sorted(tuple(r) for r in C.pair_counts(inc, min_weight, block).select("src", "dst", "weight").collect())
    assert got == _brute(rows, min_weight)


@SETTINGS
@given(rows=incidences, anchors=st.lists(st.integers(0, 40), min_size=1, max_size=4, unique=True))
def test_anchored_counts_match_pairs(spark, rows, anchors):
    inc = spark.createDataFrame(rows, "g long, item long").distinct()
    got = sorted(tuple(r) for r in C.anchored_pair_counts(inc, anchors, 2).collect())
    want = sorted((a, (y if a == x else x), w) for x, y, w in _brute(rows, 2) for a in anchors if a in (x, y))
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 9), st.integers(1, 3)),
                     min_size=1, max_size=60))
def test_keep_latest_matches_sort(spark, rows):
    df = spark.createDataFrame(rows, "k long, t long, v long, load_no int")
    got = sorted(tuple(r) for r in R.keep_latest(df, ["k"], "load_no", ["t", "v"]).collect())
    best = {}
    for k, t, v, load in rows:
        key = (-load, t, v)
        if k not in best or key < best[k][0]:
            best[k] = (key, (k, t, v, load))
    assert got == sorted(x for _, x in best.values())
