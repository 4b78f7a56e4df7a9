"""The registered queries against their SQL, and the pipeline against a brute-force version."""
import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_data import duck_mid, sf_mid, sf_small  # noqa: F401
from stargraph.llm import queries
from stargraph.testing import compare
from test_operators import brute_hits, brute_lines, brute_simhash, brute_targets


def test_names_and_sql():
    import __spark_entry__ as E

    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck_mid, sf_mid, name):
    df = queries.QUERIES[name](spark, sf_mid)
    rows = [tuple(r) for r in df.collect()]
    cur = duck_mid.execute(queries.ORACLE[name])
    assert not compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())


def test_pipeline_matches_brute_force(spark, sf_small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r.doc_id for r in queries.op3_quality(spark, sf_small).collect() if r.predicted}
    cleaned = {d: kept for d, (_, _, kept) in brute_lines([(d, docs[d].text) for d in sorted(good)]).items()}
    prints = {d: brute_simhash(t) for d, t in cleaned.items()}
    group = {d: d for d in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    single = {d: t for d, t in cleaned.items() if root(d) == d}
    clean = {d: t for d, *_, hit in brute_hits(single.items(), bench) if not hit for t in [single[d]]}
    sizes = {d: len(t.encode().split()) for d, t in clean.items()}
    per_source = collections.Counter()
    for d in clean:
        per_source[docs[d].source] += sizes[d]
    target = brute_targets(dict(per_source))
    taken, seen = {}, collections.Counter()
    for d in sorted(clean, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
        source, at = docs[d].source, seen[docs[d].source]
        whole = int(target[source])
        taken[d] = sum(min(max(whole - at - per_source[source] * k, 0), sizes[d]) for k in (0, 1))
        seen[source] += sizes[d]
    rows = corpus_pipeline.run(spark, sf_small).collect()
    assert sorted((r.doc_id, r.text, r.source, r.n_chars, r.taken) for r in rows) == sorted(
        (d, t, docs[d].source, len(t), taken[d]) for d, t in clean.items()
    )
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_stages_on_odd_and_empty_tables(spark, sf_small):
    rows = [(1, "a b c d e f g h i j k l", "en", "s1", 23), (1, "a b c d e f g h i j k l", "en", "s1", 23), (2, None, None, None, None),
            (None, "", "de", None, 0), (3, "wort " * 40_000, "de", "s2", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("_score", F.lit("mine")).withColumn("_STATS", F.lit(1)).withColumn("a.b", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_small)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert {(r["_score"], r["_STATS"], r["a.b"]) for r in out.collect()} <= {("mine", 1, 2)}
        assert out.count() <= len(rows) and stage(spark, docs.limit(0), sf_small).count() == 0


def test_ties_are_broken_by_content(spark, sf_small):
    """Rows with equal ids that differ elsewhere: the same rows, whatever their order and partitions."""
    rows = [(1, "one text of some words", "en", "s1", 22), (1, "one text of some words", "de", "s2", 22), (1, "one text of some words", None, "s1", 22),
            (2, "four words are here", "en", "s1", 19), (2, "here are four words", "en", "s1", 19)] + [
            (i, f"w{i} x y z", "en", "s1", 8) for i in range(3, 9)]
    stages, seen = dict(corpus_pipeline.STAGES), set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.repartition(parts)
        kept = [stages["near_duplicates"](spark, docs, sf_small), stages["mixing"](spark, docs, sf_small)]
        seen.add(tuple(tuple(sorted(map(str, df.collect()))) for df in kept))
    assert len(seen) == 1
