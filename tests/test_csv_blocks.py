"""CSV records cut by blocks against the whole-file reader: stray, doubled and unclosed quotes, long records, bytes."""
import collections
import os
import random
import tempfile

import pytest

from stargraph.session import scratch_path
from stargraph.sources import csv_blocks, review_export
from stargraph.sources import files as S

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def blocks(spark):
    """Sets the block size of a test."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(keys, (size, 1 << 20))]
    for k in keys:
        spark.conf.unset(k)


def folder(texts):
    path = tempfile.mkdtemp(prefix="stargraph-csv-")
    for i, text in enumerate(texts):
        with open(os.path.join(path, f"f{i:03}.csv"), "wb") as out:
            out.write(text if isinstance(text, bytes) else text.encode())
    return path


def rows(spark, path, split):
    found = S._flagged(spark, path, S._schema(COLUMNS), False, split)
    return collections.Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_split_equals_whole_file(spark, blocks, seed):
    rng = random.Random(seed)
    parts = ["a", "é", '"', ",", "\n", 'x"', " ", '""', '",', ",\n", '","']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))).rstrip("\n") for _ in range(14)]
    path = folder(texts)
    whole = rows(spark, path, False)
    blocks(60)
    assert rows(spark, path, True) == whole


def test_stray_quote_costs_nothing(spark, blocks):
    lines = [f"{i},v{i},1" for i in range(20_000)]
    lines[5] = '5,5" pipe,1'
    path = folder(["\n".join(["a,b,c", *lines]) + "\n"])
    blocks(20_000)
    for split in (False, True):
        found = {r.a: r.b for r in S.read_csv_tolerant(spark, path, COLUMNS, split=split).collect()}
        assert len(found) == 20_000 and found["5"] == '5" pipe' and found["19999"] == "v19999"
        assert S.read_csv_strict_arity(spark, path, COLUMNS, split=split).count() == 20_000


def test_other_way_for_many_blocks(spark, blocks):
    text = "".join(f'{i},"line\n{"x" * (i % 40)}""\n",z\n' for i in range(200))
    path = folder([text, text.replace("z", "y")])
    blocks(500)
    few = csv_blocks.records(spark, path)
    many = csv_blocks.records(spark, path, broadcast_blocks=0)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 400
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_long_records_are_bad_records(spark, blocks, monkeypatch):
    lines = [f'{i},"v\n{i}",1' for i in range(300)]
    lines[100] = '100,"' + "long\n" * 2_000 + '",1'
    path = folder(["\n".join(["a,b,c", *lines, '300,"never closed', *["plain line"] * 600]) + "\n"])
    blocks(1_000)
    found = csv_blocks.records(spark, path, limit=3_000).collect()
    bad = [r.size for r in found if r.record is None]
    assert len(lines[100]) in bad and len(bad) == 2
    monkeypatch.setattr(csv_blocks.records, "__defaults__", (*csv_blocks.records.__defaults__[:1], 3_000, csv_blocks.BROADCAST_BLOCKS))
    kept = S.read_csv_tolerant(spark, path, COLUMNS, split=True).collect()
    assert {int(r.a) for r in kept} == set(range(300)) - {100}
    report = S.cleaning_report(S.read_csv_all_records(spark, path, COLUMNS, split=True)).first()
    assert tuple(report) == (301, 299, 2)


@pytest.mark.parametrize("split", [False, True])
def test_only_undecodable_bytes_are_dropped(spark, split):
    text = b"a,b,c\n1,x\xff\xef\xbf\xbdy\xe4,2\n3,\xc3\xa9\xed\xa0\x80\xf0\x9f\x98\x80,\xf4\x90\x80\x80z\n"
    got = sorted(tuple(r) for r in S.read_csv_strict_arity(spark, folder([text]), COLUMNS, split=split).collect())
    assert got == [("1", "x�y", "2"), ("3", "é😀", "z")]


@pytest.mark.parametrize("split", [False, True])
def test_report_comes_from_the_run_itself(spark, split):
    raw = folder(['stars,review_id\n5,r1\n"4\n",r2\n1,2,3\n', "stars,review_id\n9\n"])
    tsv, report = scratch_path(spark, "tsv"), scratch_path(spark, "report")
    review_export.clean_reviews(spark, raw, tsv, report, split=split)
    review_export.clean_reviews(spark, folder(["stars,review_id\n"]), scratch_path(spark, "tsv"), report, split=split)
    got = sorted(tuple(r) for r in spark.read.schema("input long, kept long, dropped long").json(report).collect())
    assert got == [(0, 0, 0), (4, 2, 2)]
    assert sorted(r.value for r in spark.read.text(tsv).collect()) == sorted(["review_id\tstars"] * 1 + ["r1\t5", "r2\t4 "])
