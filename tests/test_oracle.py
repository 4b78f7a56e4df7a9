"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check runs it at sf0.01)."""
import pytest

from conftest import SF_SMALL
from stargraph.plans import registry
from stargraph.testing import compare


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.ORACLE[name])
    ocols = [d[0] for d in cur.description]
    problems = compare(df.columns, rows, ocols, cur.fetchall())
    assert not problems, problems


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 15
    assert df.columns == ["pid", "title", "score", "stars", "reviews", "cat_name", "category", "rel_type", "pid2",
                          "title2", "weight"]
    assert set(registry.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
