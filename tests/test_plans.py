"""Plan checks: no cartesian products, no row-at-a-time Python, partial aggregation before shuffles."""
import pytest

from conftest import SF_SMALL
from stargraph.plans import registry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# queries that write files inside the callable (their returned frame reads the written files back)
WRITERS = {"read_csv_tolerant", "read_csv_strict_arity", "read_jsonl", "read_tsv", "write_csv_quote_all",
           "write_tsv_noquote", "write_graph_tables", "write_report_counts", "incremental_reload", "clean_to_graph", "maintained_products",
           "maintained_reviewers", "maintained_co_purchased", "merge_categories", "batch_writes"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - WRITERS))
def test_no_forbidden_nodes(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_copurchase_plan_partial_aggregation(spark):
    plan = _plan(registry.QUERIES["build_co_purchased"](spark, SF_SMALL))
    assert "partial_count" in plan
    assert "Generate explode" not in plan  # no reviewer above the block size: the plain self-join
    assert "distinct" not in plan.lower() or plan.count("ReusedExchange") >= 1


def test_top_n_per_category_has_partial_group_limit(spark):
    df = registry.QUERIES["top_n_per_category"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_prunes_columns(spark):
    df = registry.QUERIES["filter_language"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    df = registry.QUERIES["review_year"](spark, SF_SMALL)
    plan = _plan(df)
    assert "l_extendedprice" not in plan and "l_discount" not in plan


def test_graph_tables_read_the_written_reviews(spark):
    """The keyed load runs once, in the write: graph tables scan the written copy, not ``lineitem``, and drop
    bots with a broadcast anti join against the written (measured) bot list – no shuffle of the reviews."""
    g = registry.graph(spark, SF_SMALL)
    plan = _plan(g.reviews)
    assert "lineitem" not in plan
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert "Exchange" not in plan.split("LeftAnti")[0]


def test_product_nodes_single_aggregation_pass(spark):
    """Counts, sums and text from one hash pre-aggregate; no join of a stats branch with a text branch,
    and the global mean is a global aggregate (no per-product stage inside the subquery)."""
    g = registry.graph(spark, SF_SMALL)
    df = g.products
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = [ln for ln in plan.splitlines() if "Join" in ln]
    assert joins and all("LeftAnti" in ln for ln in joins), joins
    assert "SortMergeJoin" not in _plan(df)
    assert "partial_count(1)" in plan and "partial_sum" in plan
