"""Registered queries: ``name → (spark callable(spark, sf_dir) → DataFrame, DuckDB oracle SQL or None)``.

Every query reads the driver tables of ``sf_dir`` in full; parameters that make a filter bite on the test
data are given here, the library defaults stay those of the reference.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import ReviewGraph, build_graph
from ..operators.reviews import reviews_from_tables
from ..session import materialize
from ..sources.tables import Tables
from . import intents as Q
from . import sql_oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Test parameters (the library defaults are the reference's: 5 / 3 reviews, k = 15 / 10 / 20 / 30).
MIN_REVIEWS = 20
ANCHOR = 28
CATEGORY = "STANDARD"
BOT_TEST = O.BOT_TEST
ROWS_PER_TASK = 1_000_000
RARE_WEIGHT = 4  # co-purchase weight at which some products have no neighbour


def rare(sql: str) -> str:
    """A query over co-purchase edges of at least ``RARE_WEIGHT``."""
    assert "e.weight >= 2" in sql
    return sql.replace("e.weight >= 2", f"e.weight >= {RARE_WEIGHT}")


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return reviews_from_tables(t.lineitem, t.orders, t.part)


def graph(spark: SparkSession, sf_dir: str, **kw) -> ReviewGraph:
    kw.setdefault("materialize", True)
    kw.setdefault("bot_min_reviews", BOT_TEST[0])
    kw.setdefault("bot_min_ratio", BOT_TEST[1])
    return build_graph(reviews(spark, sf_dir), **kw)


# ── intent queries ───────────────────────────────────────────────────────────────────────────────────────
@query("top_rated", O.top_rated(MIN_REVIEWS, 15))
def _q1(spark, d):
    return Q.top_rated(graph(spark, d), min_reviews=MIN_REVIEWS, k=15)


@query("top_by_category", O.top_by_category(CATEGORY, MIN_REVIEWS, 15))
def _q2(spark, d):
    return Q.top_by_category(graph(spark, d), CATEGORY, min_reviews=MIN_REVIEWS, k=15)


@query("copurchase_by_product", O.copurchase_by_product(ANCHOR, 15))
def _q3(spark, d):
    return Q.copurchase_by_product(graph(spark, d), ANCHOR, k=15)


@query("copurchase_global", O.copurchase_global(10))
def _q4(spark, d):
    return Q.copurchase_global(graph(spark, d), k=10)


@query("category_affinity_edges", O.copurchase_global(20, cross_only=True))
def _q5(spark, d):
    return Q.category_affinity_edges(graph(spark, d), k=20)


@query("combined_score_rows", rare(O.combined_score_rows(MIN_REVIEWS, 10)))
def _q6(spark, d):
    return Q.combined_score_rows(graph(spark, d, min_weight=RARE_WEIGHT), min_reviews=MIN_REVIEWS, k=10)


@query("combined_score_rank", rare(O.combined_score_rank(MIN_REVIEWS, 15)))
def _q7(spark, d):
    return Q.combined_score_rank(graph(spark, d, min_weight=RARE_WEIGHT), min_reviews=MIN_REVIEWS, k=15)


@query("top_n_per_category", O.top_n_per_category(10, MIN_REVIEWS))
def _q8(spark, d):
    return Q.top_n_per_category(graph(spark, d), n=10, min_reviews=MIN_REVIEWS)


@query("product_neighbourhood", O.product_neighbourhood(ANCHOR, 30))
def _q10(spark, d):
    return Q.product_neighbourhood(reviews(spark, d), ANCHOR, k=30)


# ── shared helpers for the operator queries ──────────────────────────────────────────────────────────────
from pyspark.sql import functions as F  # noqa: E402

from ..operators import aggregates as A  # noqa: E402
from ..operators import graph as G  # noqa: E402
from ..operators import patterns as J  # noqa: E402
from ..operators import reviews as R  # noqa: E402

META_MAX_SIZE = 45  # titles known only for parts up to this size, so title coverage is below 100 %
# Two of the per-category datasets come without titles.
UNTITLED_DATASETS = ["ECONOMY", "PROMO"]

RAW = "WITH " + O.RAW_REVIEWS


def title_meta(spark, d):
    t = Tables(spark, d)
    return t.part.filter(F.col("p_size") <= META_MAX_SIZE).select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title")
    )


META_SQL = f"meta AS (SELECT p_partkey AS product_id, p_name AS title FROM part WHERE p_size <= {META_MAX_SIZE})"


# ── A: aggregations ──────────────────────────────────────────────────────────────────────────────────────
@query("product_stats", O.q("""
SELECT product_id, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS BIGINT) AS sum_stars,
       CAST(sum(stars) AS DOUBLE) / count(*) AS avg_stars FROM reviews GROUP BY product_id"""))
def _a1(spark, d):
    return A.product_stats(graph(spark, d).reviews)


@query("reviewer_stats", O.q("""
SELECT reviewer_id, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS BIGINT) AS sum_stars,
       CAST(sum(stars) AS DOUBLE) / count(*) AS avg_stars FROM reviews GROUP BY reviewer_id"""))
def _a2(spark, d):
    return A.reviewer_stats(graph(spark, d).reviews)


@query("bayesian_score", O.q("""
SELECT product_id, review_count, sum_stars, CAST(sum_stars AS DOUBLE) / review_count AS avg_stars,
       (CAST(10 AS DOUBLE) * gmean.mean_stars + sum_stars) / (CAST(10 AS DOUBLE) + review_count) AS bayesian_score
FROM pstats, gmean"""))
def _a3(spark, d):
    return A.bayesian_score(A.product_stats(graph(spark, d).reviews), prior_weight=10.0)


@query("active_in", O.q("""
SELECT reviewer_id, category, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS DOUBLE) / count(*) AS avg_stars
FROM reviews WHERE category <> '' GROUP BY reviewer_id, category HAVING count(*) >= 2"""))
def _a4(spark, d):
    return A.active_in(graph(spark, d).reviews, min_reviews=2)


def order_buyers(r):
    """Reviews with the order as the buyer: many orders hold one product only, every reviewer holds more."""
    return r.withColumn("reviewer_id", F.floor(F.col("review_id") / 10))


@query("multi_buyer_stats", O.q(""",
per AS (SELECT review_id // 10 AS buyer, count(DISTINCT product_id) AS n FROM reviews GROUP BY 1 HAVING count(DISTINCT product_id) > 1)
SELECT CAST(count(*) AS BIGINT) AS multi_buyers, CAST(sum(n) AS DOUBLE) / count(*) AS avg_items,
       CAST(max(n) AS BIGINT) AS max_items FROM per"""))
def _a5(spark, d):
    return A.multi_buyer_stats(order_buyers(graph(spark, d).reviews))


@query("multi_buyer_share", """
WITH per AS (SELECT o.o_orderpriority, l.l_orderkey, count(DISTINCT l.l_partkey) AS n
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS buyers, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS multi_buyers,
       count(*) FILTER (WHERE n > 1) * 100.0 / count(*) AS multi_buyer_pct
FROM per GROUP BY o_orderpriority""")
def _a6(spark, d):
    t = Tables(spark, d)
    # join and aggregate are by the order: tasks of a bounded number of rows, however large the table
    n = max(spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // ROWS_PER_TASK))
    rows = t.lineitem.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").join(
        t.orders.select("o_orderkey", "o_orderpriority").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return A.multi_buyer_share(rows, "o_orderpriority", "l_orderkey", "l_partkey")


@query("category_distribution", O.q("""
SELECT category, CAST(count(*) AS BIGINT) AS reviews FROM reviews GROUP BY category"""))
def _a7(spark, d):
    return A.category_distribution(graph(spark, d).reviews)


@query("category_affinity_directed", O.q("""
SELECT src_category, dst_category, CAST(count(*) AS BIGINT) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight
FROM co WHERE src_category <> dst_category GROUP BY src_category, dst_category"""))
def _a8(spark, d):
    return A.category_affinity_directed(graph(spark, d).co_purchased)


@query("category_affinity_undirected", O.q("""
SELECT least(src_category, dst_category) AS category_a, greatest(src_category, dst_category) AS category_b,
       CAST(count(*) AS BIGINT) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight
FROM co WHERE src_category <> dst_category GROUP BY 1, 2"""))
def _a9(spark, d):
    return A.category_affinity_undirected(graph(spark, d).co_purchased)


GRAPH_PARTS_SQL = """,
parts AS (
  SELECT 'node' AS kind, 'Product' AS name, CAST(count(*) AS BIGINT) AS n FROM products
  UNION ALL SELECT 'node', 'Reviewer', count(*) FROM (SELECT DISTINCT reviewer_id FROM reviews)
  UNION ALL SELECT 'node', 'Category', count(*) FROM categories
  UNION ALL SELECT 'relationship', 'REVIEWED', count(*) FROM reviews
  UNION ALL SELECT 'relationship', 'CO_PURCHASED', count(*) FROM co
  UNION ALL SELECT 'relationship', 'BELONGS_TO', count(*) FROM belongs_to
  UNION ALL SELECT 'relationship', 'ACTIVE_IN', count(*) FROM (SELECT DISTINCT reviewer_id, category FROM reviews WHERE category <> ''))
SELECT coalesce(kind, 'all') AS kind, coalesce(name, 'total') AS name, CAST(sum(n) AS BIGINT) AS n
FROM parts GROUP BY ROLLUP (kind, name)"""


@query("graph_counts", O.q(GRAPH_PARTS_SQL))
def _a10(spark, d):
    return G.count_graph(graph(spark, d))


@query("title_coverage", RAW + "," + META_SQL + """,
m AS (SELECT product_id, min(title) AS product_title FROM meta GROUP BY product_id)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(m.product_title) AS BIGINT) AS with_title,
       count(m.product_title) * 100.0 / count(*) AS title_pct
FROM all_reviews r LEFT JOIN m ON r.product_id = m.product_id""")
def _a11(spark, d):
    return A.title_coverage(R.enrich_titles(reviews(spark, d).drop("title"), title_meta(spark, d)))


@query("copurchase_degree", O.q("""
SELECT src AS product_id, CAST(count(*) AS BIGINT) AS degree, CAST(sum(weight) AS BIGINT) AS total_weight
FROM und GROUP BY src"""))
def _a12(spark, d):
    return A.copurchase_degree(graph(spark, d).co_purchased.select("src", "dst", "weight"))


@query("weight_distribution", O.q("""
SELECT weight, CAST(count(*) AS BIGINT) AS edges, (SELECT max(weight) FROM co) AS max_weight
FROM co GROUP BY weight"""))
def _a13(spark, d):
    return A.weight_distribution(graph(spark, d).co_purchased)


@query("distinct_categories", O.q("SELECT name FROM categories"))
def _a14(spark, d):
    return graph(spark, d).categories


@query("key_uniqueness_check", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _a15(spark, d):
    return A.key_duplicates(Tables(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


# ── E: graph construction ────────────────────────────────────────────────────────────────────────────────
@query("merge_upsert", """
WITH rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
         CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS load_no FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY load_no DESC, l_partkey, l_suppkey, l_shipdate) AS rn FROM rows)
SELECT l_orderkey * 10 + l_linenumber AS review_id, load_no, l_partkey AS product_id, l_suppkey, l_shipdate AS ts,
       CAST((CAST(floor(l_quantity - 1) AS INTEGER) % 5) + 1 AS INTEGER) AS stars
FROM r WHERE rn = 1""")
def _e1(spark, d):
    li = Tables(spark, d).lineitem
    tagged = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        F.when(F.col("l_linestatus") == "F", F.lit(2)).otherwise(F.lit(1)).alias("load_no"),
    )
    existing = tagged.filter(F.col("load_no") == 1)
    incoming = tagged.filter(F.col("load_no") == 2)
    merged = R.merge_upsert(existing, incoming, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])
    return merged.select(
        R.review_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("review_id"), "load_no",
        F.col("l_partkey").alias("product_id"), "l_suppkey", F.col("l_shipdate").alias("ts"),
        R.stars_from_quantity(F.col("l_quantity")).alias("stars"),
    )


@query("build_product_nodes", O.q("SELECT * FROM products"))
def _e2(spark, d):
    return graph(spark, d).products


@query("build_reviewer_nodes", O.q("""
SELECT reviewer_id, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS DOUBLE) / count(*) AS avg_stars
FROM reviews GROUP BY reviewer_id"""))
def _e3(spark, d):
    return graph(spark, d).reviewers


@query("build_reviewed", O.q("""
SELECT r.reviewer_id AS src, r.product_id AS dst, r.review_id, r.stars, r.ts AS timestamp,
       CAST(year(r.ts) AS INTEGER) AS year, p.bayesian_score
FROM reviews r JOIN products p ON r.product_id = p.product_id"""))
def _e4(spark, d):
    return graph(spark, d).reviewed


@query("build_belongs_to", O.q("SELECT src, dst FROM belongs_to"))
def _e5(spark, d):
    return graph(spark, d).belongs_to


@query("build_co_purchased", O.q("SELECT src, dst, weight, cross_cat, src_category, dst_category FROM co"))
def _e6(spark, d):
    return graph(spark, d).co_purchased


@query("build_similar_to_v1", RAW + "," + O.bots_cte(*BOT_TEST) + """,
inc AS (SELECT DISTINCT reviewer_id AS g, product_id AS item FROM all_reviews
        WHERE reviewer_id NOT IN (SELECT reviewer_id FROM bots))
SELECT a.item AS src, b.item AS dst, CAST(count(*) AS BIGINT) AS weight
FROM inc a JOIN inc b ON a.g = b.g AND a.item < b.item GROUP BY a.item, b.item""")
def _e7(spark, d):
    return G.build_similar_to(graph(spark, d).reviews)


@query("build_v1_edges", RAW + """
SELECT DISTINCT reviewer_id AS src, 'PURCHASED' AS type, product_id AS dst FROM all_reviews
UNION ALL SELECT reviewer_id, 'WROTE', review_id FROM all_reviews
UNION ALL SELECT review_id, 'ABOUT', product_id FROM all_reviews""")
def _e8(spark, d):
    return G.build_v1_edges(reviews(spark, d))


@query("build_v1_nodes", RAW + """
SELECT DISTINCT 'Customer' AS label, reviewer_id AS id FROM all_reviews
UNION ALL SELECT DISTINCT 'Product', product_id FROM all_reviews
UNION ALL SELECT 'Review', review_id FROM all_reviews""")
def _e9(spark, d):
    return G.build_v1_nodes(reviews(spark, d))


@query("merge_categories", RAW + f"""
SELECT review_id, reviewer_id, product_id,
       CASE WHEN category IN ({", ".join(repr(c) for c in UNTITLED_DATASETS)}) THEN NULL ELSE title END AS title,
       stars, ts, category
FROM all_reviews""")
def _e10(spark, d):
    """Every category as a dataset in a folder of its own, some without the title column, read in one scan."""
    from ..session import scratch_path
    from ..sources.files import read_datasets

    r = materialize(reviews(spark, d), "categories")
    root = scratch_path(spark, "datasets")
    untitled = F.coalesce(F.col("category").isin(UNTITLED_DATASETS), F.lit(False))
    r.filter(~untitled).write.partitionBy("category").parquet(root)
    r.filter(untitled).drop("title").write.mode("append").partitionBy("category").parquet(root)
    return read_datasets(spark, root, r.drop("category").schema)


@query("batch_writes", RAW + """
SELECT review_id, CAST(bucket AS INTEGER) AS bucket,
       CAST((row_number() OVER (PARTITION BY bucket ORDER BY review_id) - 1) // 500 AS INTEGER) AS batch
FROM (SELECT review_id, review_id % greatest(1, CAST(ceil((SELECT count(*) FROM all_reviews) / 5000.0) AS BIGINT)) AS bucket
      FROM all_reviews)""")
def _e11(spark, d):
    """All review ids sent in batches: a first run fails in its third wave, a second one sends what is missing."""
    from ..session import scratch_path
    from ..sources import batches as B

    r = materialize(reviews(spark, d).select("review_id"), "batch-ids")
    path = scratch_path(spark, "batches")
    how = dict(bucket_rows=5000, bucket_of=lambda n: F.pmod(F.col("review_id"), n))

    def lost(wave: int) -> None:
        if wave == 2:
            raise ConnectionError("receiver lost")

    try:
        B.send_batches(r, "review_id", path, after_wave=lost, **how)
    except ConnectionError:
        B.send_batches(r, "review_id", path, **how)
    return B.sent_rows(spark, path, r.schema)


# ── P: projections and filters ───────────────────────────────────────────────────────────────────────────
WANTED_DOC_COLUMNS = ["doc_id", "stars", "text", "lang", "review_title"]


@query("select_existing", "SELECT doc_id, text, lang FROM documents")
def _p1(spark, d):
    from ..sources.files import select_existing

    return select_existing(Tables(spark, d).documents, WANTED_DOC_COLUMNS)


@query("alias_projection", O.q("""
SELECT product_id AS pid, title, bayesian_score AS score, avg_stars AS stars, review_count AS reviews, category
FROM products"""))
def _p2(spark, d):
    p = graph(spark, d).products
    return p.select(*Q._product_row(p), "category")


@query("literal_columns", O.q("""
SELECT product_id AS pid, 'BELONGS_TO' AS rel_type, CAST(NULL AS BIGINT) AS pid2, CAST(NULL AS VARCHAR) AS title2,
       CAST(NULL AS BIGINT) AS weight, true AS cross_cat FROM products"""))
def _p3(spark, d):
    p = graph(spark, d).products
    return p.select(
        F.col("product_id").alias("pid"), F.lit("BELONGS_TO").alias("rel_type"), Q._null("bigint").alias("pid2"),
        Q._null("string").alias("title2"), Q._null("bigint").alias("weight"), F.lit(True).alias("cross_cat"),
    )


@query("filter_min_reviews", O.q(f"SELECT * FROM products WHERE review_count >= {MIN_REVIEWS}"))
def _p4(spark, d):
    return graph(spark, d).products.filter(F.col("review_count") >= MIN_REVIEWS)


@query("filter_by_id", RAW + f"\nSELECT * FROM all_reviews WHERE product_id = {ANCHOR}")
def _p5(spark, d):
    return reviews(spark, d).filter(F.col("product_id") == F.lit(ANCHOR))


@query("filter_category", O.q(f"SELECT * FROM products WHERE category = '{CATEGORY}'"))
def _p6(spark, d):
    return graph(spark, d).products.filter(F.col("category") == F.lit(CATEGORY))


@query("filter_cross_cat", O.q("SELECT src, dst, weight, cross_cat, src_category, dst_category FROM co WHERE cross_cat"))
def _p7(spark, d):
    return graph(spark, d).co_purchased.filter("cross_cat")


@query("filter_language", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE lang = 'en'")
def _p8(spark, d):
    return Tables(spark, d).documents.filter(F.col("lang") == "en")


@query("filter_bots", RAW + "," + O.bots_cte(*BOT_TEST) + "\nSELECT reviewer_id, review_count, modal_count, ratio FROM bots")
def _p9(spark, d):
    return R.flag_bots(reviews(spark, d), *BOT_TEST)


BUDGET_FRACTION = 0.5


@query("subset_to_budget", RAW + f""",
cnt AS (SELECT reviewer_id, count(*) AS n FROM all_reviews GROUP BY reviewer_id),
hist AS (SELECT n, sum(n) AS rows FROM cnt GROUP BY n),
tot AS (SELECT CAST(floor(sum(rows) * {BUDGET_FRACTION}) AS BIGINT) AS budget FROM hist),
suf AS (SELECT n, sum(rows) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM hist),
k AS (SELECT min(n) AS k FROM suf, tot WHERE kept <= budget)
SELECT r.* FROM all_reviews r JOIN cnt c ON r.reviewer_id = c.reviewer_id, k WHERE c.n >= k.k""")
def _p10(spark, d):
    return R.budget_subset(reviews(spark, d), budget_fraction=BUDGET_FRACTION)


# ── J: graph patterns ────────────────────────────────────────────────────────────────────────────────────
@query("expand_directed", O.q("""
SELECT p.product_id AS pid, c.name AS category FROM products p
JOIN belongs_to b ON p.product_id = b.src JOIN categories c ON b.dst = c.name"""))
def _j1(spark, d):
    g = graph(spark, d)
    x = J.expand(g.products, "product_id", g.belongs_to, g.categories, "name")
    return x.select(F.col("product_id").alias("pid"), F.col("name").alias("category"))


@query("expand_undirected", O.q("""
SELECT p.product_id AS pid, q.product_id AS pid2, u.weight FROM products p
JOIN und u ON p.product_id = u.src JOIN products q ON u.dst = q.product_id"""))
def _j2(spark, d):
    g = graph(spark, d)
    p1 = g.products.select("product_id")
    p2 = g.products.select(F.col("product_id").alias("pid2"))
    x = J.expand_undirected(p1, "product_id", g.co_purchased.select("src", "dst", "weight"), p2, "pid2")
    return x.select(F.col("product_id").alias("pid"), "pid2", "weight")


@query("expand_both_endpoints", O.q("""
SELECT co.src, co.dst, co.weight, a.title AS title1, a.bayesian_score AS score1, a.avg_stars AS stars1,
       a.review_count AS reviews1, ba.dst AS category1, b.title AS title2, b.bayesian_score AS score2,
       b.avg_stars AS stars2, b.review_count AS reviews2, bb.dst AS category2
FROM co JOIN products a ON co.src = a.product_id JOIN belongs_to ba ON a.product_id = ba.src
        JOIN products b ON co.dst = b.product_id JOIN belongs_to bb ON b.product_id = bb.src"""))
def _j3(spark, d):
    g = graph(spark, d)
    return J.endpoint_attributes(g.co_purchased.select("src", "dst", "weight"), g.products, g.belongs_to)


@query("optional_expand", rare(O.q(f"""
SELECT p.product_id AS pid, u.dst AS pid2, u.weight, b2.dst AS category2
FROM products p LEFT JOIN und u ON p.product_id = u.src LEFT JOIN belongs_to b2 ON u.dst = b2.src
WHERE p.review_count >= {MIN_REVIEWS}""")))
def _j4(spark, d):
    g = graph(spark, d, min_weight=RARE_WEIGHT)
    p = g.products.filter(F.col("review_count") >= MIN_REVIEWS).select("product_id")
    und = J.union_directions(g.co_purchased.select("src", "dst", "weight"))
    step = p.join(und, p.product_id == und.src, "left")
    b2 = g.belongs_to.select(F.col("src").alias("__b"), F.col("dst").alias("category2"))
    return step.join(b2, F.col("dst") == b2.__b, "left").select(
        F.col("product_id").alias("pid"), F.col("dst").alias("pid2"), "weight", "category2"
    )


@query("optional_bound_check", RAW + """,
pr AS (SELECT DISTINCT reviewer_id, product_id AS pid FROM all_reviews),
rv AS (SELECT product_id, min(review_id) AS review_id FROM all_reviews GROUP BY product_id)
SELECT p.reviewer_id, p.pid, r.review_id,
       EXISTS (SELECT 1 FROM all_reviews w WHERE w.reviewer_id = p.reviewer_id AND w.review_id = r.review_id) AS wrote
FROM pr p JOIN rv r ON p.pid = r.product_id""")
def _j5(spark, d):
    """Every purchase with the product's first review: did this buyer write it?"""
    r = materialize(reviews(spark, d).select("reviewer_id", "product_id", "review_id"), "bound-check")
    first = r.groupBy(F.col("product_id").alias("pid")).agg(F.min("review_id").alias("review_id"))
    rows = r.select("reviewer_id", F.col("product_id").alias("pid")).distinct().join(first, "pid")
    wrote = r.select(F.col("reviewer_id").alias("src"), F.col("review_id").alias("dst"))
    return J.optional_bound_check(rows, wrote, "reviewer_id", "review_id", "wrote").select(
        "reviewer_id", "pid", "review_id", "wrote"
    )


@query("two_hop_copurchase", RAW + f""",
pr AS (SELECT DISTINCT reviewer_id, product_id FROM all_reviews)
SELECT a.product_id AS pid, a.reviewer_id, b.product_id AS other_id
FROM pr a JOIN pr b ON a.reviewer_id = b.reviewer_id AND b.product_id <> a.product_id
WHERE a.product_id = {ANCHOR}""")
def _j6(spark, d):
    return J.two_hop(reviews(spark, d).select("reviewer_id", "product_id").distinct(), ANCHOR)


@query("enrich_titles", RAW + "," + META_SQL + """,
m AS (SELECT product_id, min(title) AS product_title FROM meta GROUP BY product_id)
SELECT r.review_id, r.product_id, m.product_title FROM all_reviews r LEFT JOIN m ON r.product_id = m.product_id""")
def _j7(spark, d):
    e = R.enrich_titles(reviews(spark, d).drop("title"), title_meta(spark, d))
    return e.select("review_id", "product_id", "product_title")


@query("exclude_reviewers", RAW + "," + O.bots_cte(*BOT_TEST) + """
SELECT * FROM all_reviews WHERE reviewer_id NOT IN (SELECT reviewer_id FROM bots)""")
def _j8(spark, d):
    r = reviews(spark, d)
    return R.drop_bots(r, R.flag_bots(r, *BOT_TEST))


@query("keep_multibuyers", RAW + """,
bought AS (SELECT * REPLACE (review_id // 10 AS reviewer_id) FROM all_reviews),
multi AS (SELECT reviewer_id FROM bought GROUP BY reviewer_id HAVING count(DISTINCT product_id) > 1)
SELECT * FROM bought WHERE reviewer_id IN (SELECT reviewer_id FROM multi)""")
def _j9(spark, d):
    return R.keep_multibuyers(order_buyers(reviews(spark, d)))


@query("edge_cross_cat", O.q("SELECT src, dst, weight, src_category, dst_category, cross_cat FROM co"))
def _j10(spark, d):
    g = graph(spark, d)
    edges = G.co_purchase_edges(g.reviews, 2)
    return G.with_categories(edges, g.belongs_to)


# ── G: subgraph assembly ─────────────────────────────────────────────────────────────────────────────────
from . import retrieval as RT  # noqa: E402
from . import subgraph as SG  # noqa: E402
from ..functions import text as X  # noqa: E402


@query("subgraph_nodes", O.q(O.cte_pairs_anchor("rows", ANCHOR, 15) + O.subgraph_nodes_sql("rows")
                             + "\nSELECT * FROM sg_nodes"))
def _g1(spark, d):
    g = graph(spark, d)
    _, rows = Q.subgraph_rows(g, "copurchase", entity_id=ANCHOR)
    return SG.subgraph_nodes(rows, g.products)


@query("subgraph_edges", O.q(O.cte_pairs_anchor("rows", ANCHOR, 15) + O.subgraph_edges_sql("rows")
                             + "\nSELECT * FROM sg_edges"))
def _g2(spark, d):
    g = graph(spark, d)
    _, rows = Q.subgraph_rows(g, "copurchase", entity_id=ANCHOR)
    return SG.subgraph_edges(rows)


@query("subgraph_summary", O.q(O.cte_combined("rows", 5, 10) + O.subgraph_nodes_sql("rows")
                               + O.subgraph_edges_sql("rows") + """
SELECT CAST((SELECT count(*) FROM sg_nodes) AS BIGINT) AS nodes,
       CAST((SELECT count(*) FROM sg_edges) AS BIGINT) AS relationships"""))
def _g3(spark, d):
    g = graph(spark, d)
    _, rows = Q.subgraph_rows(g, "combined_score")
    return SG.subgraph_summary(SG.subgraph_nodes(rows, g.products), SG.subgraph_edges(rows))


INTENTS = ("top_rated", "top_by_category", "copurchase", "category_affinity", "combined_score", "copurchase_of_product")


def _summary_sql(name: str, cte: str, two_ended: bool) -> str:
    """One branch's node and relationship counts; rows of one end get an empty second end."""
    rows = "rows" if two_ended else "(SELECT *, CAST(NULL AS BIGINT) AS pid2, CAST(NULL AS VARCHAR) AS category2, CAST(NULL AS BIGINT) AS weight FROM rows)"
    return f"SELECT '{name}' AS intent, * FROM (" + O.q(cte + O.subgraph_nodes_sql(rows) + O.subgraph_edges_sql(rows) + """
SELECT CAST((SELECT count(*) FROM sg_nodes) AS BIGINT) AS nodes,
       CAST((SELECT count(*) FROM sg_edges) AS BIGINT) AS relationships""") + ")"


@query("subgraph_intents", "\nUNION ALL\n".join([
    _summary_sql("top_rated", O.cte_top_rated("rows", 5, 15), False),
    _summary_sql("top_by_category", O.cte_per_category("per_cat", 15, 3)
                 + f", rows AS (SELECT * FROM per_cat WHERE category = '{CATEGORY}')", False),
    _summary_sql("copurchase", O.cte_pairs_global("rows", 10), True),
    _summary_sql("category_affinity", O.cte_pairs_global("rows", 20, cross_only=True), True),
    _summary_sql("combined_score", O.cte_combined("rows", 5, 10), True),
    _summary_sql("copurchase_of_product", O.cte_pairs_anchor("rows", ANCHOR, 15), True)]))
def _g_all(spark, d):
    """Every branch of the dispatch (Q9) through node, edge and summary assembly."""
    built = graph(spark, d)
    g = built.with_tables(products=materialize(built.products, "products"))
    g = g.with_tables(co_purchased=materialize(g.co_purchased, "co-purchased"))
    out = None
    for name in INTENTS:
        entity = ANCHOR if name == "copurchase_of_product" else None
        _, rows = Q.subgraph_rows(g, "copurchase" if entity else name, entity, CATEGORY if name == "top_by_category" else None)
        rows = materialize(rows, f"rows-{name}")
        one = SG.subgraph_summary(SG.subgraph_nodes(rows, g.products), SG.subgraph_edges(rows))
        one = one.select(F.lit(name).alias("intent"), "nodes", "relationships")
        out = one if out is None else out.unionByName(one)
    return out


# ── R: retrieval over a table of questions ───────────────────────────────────────────────────────────────
# The three routing words map onto three part types of the test data.
TEST_CATEGORY_MAP = {"juguete": "SMALL", "deporte": "LARGE", "videojuego": "PROMO"}


def routed_questions(spark, d):
    return RT.route_intent(RT.question_table(Tables(spark, d).conversations), category_map=TEST_CATEGORY_MAP)


def contexts(spark, d, g=None):
    """The contexts of all intents; the intents read one written copy of the products and pairs."""
    g = g or written_graph(spark, d)
    return RT.intent_contexts(g, min_reviews=MIN_REVIEWS, min_reviews_category=MIN_REVIEWS)


CTX = O.contexts_cte(MIN_REVIEWS, MIN_REVIEWS)
ROUTED = O.routed_cte(TEST_CATEGORY_MAP)


@query("route_intent", RAW + ROUTED + "\nSELECT conv_id, turn, question, intent, category FROM routed")
def _r1(spark, d):
    return routed_questions(spark, d)


@query("build_context", O.q(CTX + "\nSELECT intent, category, context FROM contexts"))
def _r2(spark, d):
    return contexts(spark, d)


ANSWERS_SQL = CTX + ROUTED + """,
answers AS (SELECT r.conv_id, r.turn, r.question, r.intent, r.category, c.context
            FROM routed r LEFT JOIN contexts c ON r.intent = c.intent AND r.category IS NOT DISTINCT FROM c.category)"""


# Every third pair question names a product, every third one that does not exist; some category questions lose
# their category, and some questions have an intent that no query serves.
ENTITY_SQL = CTX + ROUTED + f""",
asked AS (SELECT conv_id, turn, question, CASE WHEN conv_id % 11 = 5 THEN 'weather' ELSE intent END AS intent,
                 CASE WHEN conv_id % 4 = 0 THEN NULL ELSE category END AS category,
                 CASE WHEN intent IN ('copurchase', 'similar_to') THEN
                   CASE conv_id % 3 WHEN 1 THEN conv_id * 48271 % (SELECT max(product_id) FROM products) + 1 WHEN 2 THEN -1 END END AS product_id
          FROM routed),
ids AS (SELECT DISTINCT product_id FROM asked WHERE product_id IS NOT NULL AND intent IN ('copurchase', 'similar_to')),
both_ways AS (
  SELECT src AS p1, dst AS p2, weight, src_category AS c1, dst_category AS c2 FROM co
  UNION ALL SELECT dst, src, weight, dst_category, src_category FROM co WHERE src <> dst),
near AS (SELECT p1, p2, weight, row_number() OVER (PARTITION BY p1 ORDER BY weight DESC, p2) AS rank
         FROM both_ways JOIN ids ON p1 = product_id WHERE c1 IS NOT NULL AND c2 IS NOT NULL),
near_rows AS (SELECT n.p1, n.rank, n.weight, a.title, a.bayesian_score AS score, a.avg_stars AS stars,
                     a.review_count AS reviews, b.title AS title2
              FROM near n JOIN products a ON n.p1 = a.product_id JOIN products b ON n.p2 = b.product_id WHERE n.rank <= 15),
near_ctx AS (SELECT p1, string_agg({O.line_sql(True)}, chr(10) ORDER BY rank) AS context FROM near_rows GROUP BY p1)
SELECT q.conv_id, q.turn, q.question, q.intent, q.category, q.product_id,
       CASE WHEN i.product_id IS NOT NULL THEN coalesce(n.context, '') ELSE c.context END AS context
FROM asked q
LEFT JOIN ids i ON q.intent IN ('copurchase', 'similar_to') AND q.product_id = i.product_id
LEFT JOIN near_ctx n ON i.product_id = n.p1
LEFT JOIN contexts c ON c.intent = CASE WHEN q.intent = 'weather' OR (q.intent = 'top_by_category' AND q.category IS NULL)
                                        THEN 'top_rated' ELSE q.intent END
  AND c.category IS NOT DISTINCT FROM CASE WHEN q.intent = 'top_by_category' THEN q.category END"""


def asked_questions(spark, d, g) -> DataFrame:
    """The routed questions of ``ENTITY_SQL``; products are drawn from the whole range of ids."""
    k = F.pmod(F.col("conv_id"), F.lit(3))
    largest = g.products.agg(F.max("product_id")).scalar()
    named = F.when(F.col("intent").isin("copurchase", "similar_to"),
                   F.when(k == 1, F.pmod(F.col("conv_id") * 48271, largest) + 1).when(k == 2, F.lit(-1)))
    return (
        routed_questions(spark, d)
        .withColumn("product_id", named.cast("bigint"))
        .withColumn("category", F.when(F.pmod(F.col("conv_id"), F.lit(4)) != 0, F.col("category")))
        .withColumn("intent", F.when(F.pmod(F.col("conv_id"), F.lit(11)) == 5, F.lit("weather")).otherwise(F.col("intent")))
    )


def written_graph(spark, d) -> ReviewGraph:
    """The graph with its products and pairs written once for the many queries that read them."""
    g = graph(spark, d)
    g = g.with_tables(products=materialize(g.products, "products"))
    return g.with_tables(co_purchased=materialize(g.co_purchased, "co-purchased"))


@query("answer_contexts", O.q(ENTITY_SQL))
def _r3(spark, d):
    g = written_graph(spark, d)
    return RT.answer_contexts(asked_questions(spark, d, g), contexts(spark, d, g), g)


QUESTION_SQL = ROUTED + """,
asked AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 5 THEN 'weather' ELSE intent END AS intent,
                 CASE WHEN conv_id % 4 = 0 THEN NULL ELSE category END AS category,
                 CASE WHEN intent IN ('copurchase', 'similar_to') THEN
                   CASE conv_id % 3 WHEN 1 THEN conv_id * 48271 % (SELECT max(product_id) FROM products) + 1 WHEN 2 THEN -1 END END AS product_id
          FROM routed),
wants AS (SELECT *, CASE WHEN intent IN ('copurchase', 'similar_to') AND product_id IS NOT NULL THEN 'p' || product_id
                         WHEN intent IN ('copurchase', 'similar_to') THEN 'copurchase'
                         WHEN intent = 'category_affinity' OR intent = 'combined_score' THEN intent
                         WHEN intent = 'top_by_category' AND category <> '' THEN 'c' || category ELSE 'top_rated' END AS want FROM asked)
""" + O.cte_top_rated("tr", 5, 15) + O.cte_per_category("pc", 15, 3) + O.cte_pairs_global("cg", 10) + O.cte_pairs_global(
    "ca", 20, cross_only=True) + O.cte_combined("cs", 5, 10) + """,
both_ways AS (
  SELECT src AS p1, dst AS p2, weight, src_category AS c1, dst_category AS c2 FROM co
  UNION ALL SELECT dst, src, weight, dst_category, src_category FROM co WHERE src <> dst),
near AS (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY weight DESC, p2) AS rank FROM both_ways
         WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND p1 IN (SELECT product_id FROM asked)),
found AS (
  SELECT 'top_rated' AS want, pid, category, CAST(NULL AS BIGINT) AS pid2, CAST(NULL AS VARCHAR) AS category2 FROM tr
  UNION ALL SELECT 'c' || category, pid, category, NULL, NULL FROM pc
  UNION ALL SELECT 'copurchase', pid, category, pid2, category2 FROM cg
  UNION ALL SELECT 'category_affinity', pid, category, pid2, category2 FROM ca
  UNION ALL SELECT 'combined_score', pid, category, pid2, category2 FROM cs
  UNION ALL SELECT 'p' || p1, p1, c1, p2, c2 FROM near WHERE rank <= 15),
ends AS (SELECT want, pid, category FROM found UNION SELECT want, pid2, category2 FROM found),
counts AS (
  SELECT want, sum(n) AS nodes, sum(r) AS relationships FROM (
    SELECT want, count(DISTINCT pid) + count(DISTINCT nullif(category, '')) AS n,
           count(*) FILTER (WHERE pid IS NOT NULL AND category <> '') AS r FROM ends GROUP BY want
    UNION ALL SELECT want, 0, count(*) FROM (SELECT DISTINCT want, least(pid, pid2), greatest(pid, pid2) FROM found
                                             WHERE pid IS NOT NULL AND pid2 IS NOT NULL) GROUP BY want) GROUP BY want)
SELECT w.conv_id, w.turn, w.intent, w.category, w.product_id, CAST(coalesce(c.nodes, 0) AS BIGINT) AS nodes,
       CAST(coalesce(c.relationships, 0) AS BIGINT) AS relationships
FROM wants w LEFT JOIN counts c ON w.want = c.want"""


@query("question_subgraphs", O.q(QUESTION_SQL))
def _g_questions(spark, d):
    """Nodes and relationships of the subgraph of every question, in one plan."""
    from . import question_subgraphs as QS

    g = written_graph(spark, d)
    asked = asked_questions(spark, d, g).select("conv_id", "turn", "intent", "category", "product_id")
    return QS.question_summary(g, asked)


# ── X: scalar and text functions ─────────────────────────────────────────────────────────────────────────
CR, LF, TAB = "\r", "\n", "\t"


def dirty_text(c):
    """Documents have no CR or TAB: sentence ends become CRLF and comma-spaces become TABs."""
    return F.replace(F.replace(F.col(c), F.lit(". "), F.lit("." + CR + LF)), F.lit(", "), F.lit("," + TAB))


DIRTY_SQL = "replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(9))"


def clean_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n', ' ', 'g'), '[\\n\\r\\t]', ' ', 'g'), "
            "'\"', '', 'g')")


@query("clean_text", f"SELECT doc_id, {clean_sql(DIRTY_SQL)} AS text FROM documents")
def _x1(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.clean_text(dirty_text("text")).alias("text"))


@query("null_text_policy", f"""
SELECT d.doc_id, {clean_sql("coalesce(CAST(l.quality AS VARCHAR), 'nan')")} AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _x2(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", X.clean_text(F.col("quality"), null_text="nan").alias("quality"))


@query("double_quotes", "SELECT doc_id, replace(text, '\"', '\"\"') AS text FROM documents")
def _x3(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.double_quotes("text").alias("text"))


STARS_RAW_SQL = """CASE (event_id % 6) WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN ' ' || CAST(value AS VARCHAR) || ' '
  WHEN 2 THEN 'nan' WHEN 3 THEN event_type WHEN 4 THEN '' ELSE NULL END"""


@query("stars_to_int", f"""
WITH r AS (SELECT event_id, {STARS_RAW_SQL} AS raw FROM events),
d AS (SELECT event_id, TRY_CAST(trim(raw) AS DOUBLE) AS v FROM r)
SELECT event_id, coalesce(TRY_CAST(trunc(CASE WHEN isnan(v) THEN 0.0 ELSE coalesce(v, 0.0) END) AS BIGINT), 0) AS stars
FROM d""")
def _x4(spark, d):
    e = Tables(spark, d).events
    k = F.pmod(F.col("event_id"), F.lit(6))
    raw = (F.when(k == 0, F.col("value").cast("string"))
           .when(k == 1, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
           .when(k == 2, F.lit("nan")).when(k == 3, F.col("event_type")).when(k == 4, F.lit("")))
    return e.select("event_id", X.stars_to_int(raw).alias("stars"))


@query("short_title", f"SELECT doc_id, {O.short_title_sql('text', 'doc_id')} AS label FROM documents")
def _x5(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.short_title(F.col("text"), F.col("doc_id")).alias("label"))


@query("table_title", "SELECT doc_id, substr(text, 1, 40) || '...' AS label FROM documents")
def _x6(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.table_title(F.col("text")).alias("label"))


@query("tooltip", O.q(f"""
SELECT product_id AS pid, {O.tooltip_sql('title', 'product_id', 'category', 'avg_stars', 'bayesian_score', 'review_count')} AS tooltip
FROM products"""))
def _x7(spark, d):
    p = graph(spark, d).products
    return p.select(
        F.col("product_id").alias("pid"),
        X.tooltip("title", "product_id", "category", "avg_stars", "bayesian_score", "review_count").alias("tooltip"),
    )


TEST_LABELS = {**X.CATEGORY_LABELS, "SMALL": "🔹 Small", "LARGE": "🔷 Large"}


@query("label_lookup", O.q("""
SELECT name, CASE name WHEN 'Toys_and_Games' THEN '🧸 Toys' WHEN 'Sports_and_Outdoors' THEN '🏃 Sports'
  WHEN 'Video_Games' THEN '🎮 Video Games' WHEN 'SMALL' THEN '🔹 Small' WHEN 'LARGE' THEN '🔷 Large' ELSE name END AS label
FROM categories"""))
def _x8(spark, d):
    return graph(spark, d).categories.select("name", X.label_lookup(F.col("name"), TEST_LABELS).alias("label"))


@query("category_node_id", O.q("SELECT name, 'cat_' || name AS node_id FROM categories"))
def _x9(spark, d):
    return graph(spark, d).categories.select("name", X.category_node_id(F.col("name")).alias("node_id"))


@query("edge_width", O.q("""
, odd AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN NULL ELSE weight - 2 + src % 12 END AS weight FROM co)
SELECT src, dst, weight, CAST(least(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END, 10) AS BIGINT) AS width
FROM odd"""))
def _x10(spark, d):
    # weights from 0 to beyond the cap, and nulls
    odd = F.when((F.col("src") + F.col("dst")) % 5 != 0, F.col("weight") - 2 + F.col("src") % 12)
    co = graph(spark, d).co_purchased.select("src", "dst", odd.alias("weight"))
    return co.select("src", "dst", "weight", X.edge_width(F.col("weight")).alias("width"))


@query("review_year", RAW + "\nSELECT review_id, CAST(year(ts) AS INTEGER) AS year FROM all_reviews")
def _x11(spark, d):
    return reviews(spark, d).select("review_id", X.review_year(F.col("ts")).alias("year"))


@query("parse_context", O.q(CTX + """
SELECT intent, category, CAST(rank - 1 AS INTEGER) AS line_no,
       substr(trim(regexp_replace(coalesce(title, ''), '[|\\r\\n]', ' ', 'g')), 1, 40) || '...' AS product,
       CAST(round(score, 2) AS VARCHAR) AS score, CAST(round(stars, 2) AS VARCHAR) AS stars,
       CAST(reviews AS VARCHAR) AS reviews
FROM (SELECT l.intent, l.category, l.rank, t.title, t.score, t.stars, t.reviews FROM ctx_lines l
      JOIN (SELECT 'top_rated' AS intent, CAST(NULL AS VARCHAR) AS category, rank, title, score, stars, reviews FROM ctx_top
            UNION ALL SELECT 'generic', NULL, rank, title, score, stars, reviews FROM ctx_top
            UNION ALL SELECT 'top_by_category', category, rank, title, score, stars, reviews FROM ctx_cat
            UNION ALL SELECT 'copurchase', NULL, rank, title, score, stars, reviews FROM ctx_co
            UNION ALL SELECT 'similar_to', NULL, rank, title, score, stars, reviews FROM ctx_co
            UNION ALL SELECT 'category_affinity', NULL, rank, title, score, stars, reviews FROM ctx_aff
            UNION ALL SELECT 'combined_score', NULL, rank, title, score, stars, reviews FROM ctx_comb) t
      ON l.intent = t.intent AND l.category IS NOT DISTINCT FROM t.category AND l.rank = t.rank)"""))
def _x12(spark, d):
    return RT.parse_context(contexts(spark, d), keep=["intent", "category"])


def responses(spark, d):
    """Gateway responses for the answered questions, in the three shapes the client accepts: ``body`` as a
    JSON string, ``body`` as an object, or no wrapper at all.  The generic intent is left out of the body."""
    a = RT.answer_contexts(routed_questions(spark, d), contexts(spark, d))
    inner = F.struct(
        F.element_at(F.split(F.col("context"), "\n"), 1).alias("answer"),
        F.when(F.col("intent") != "generic", F.col("intent")).alias("intent"),
        F.col("context"), F.col("category"),
    )
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    raw = (F.when(shape == 0, F.to_json(F.struct(F.lit(200).alias("statusCode"), F.to_json(inner).alias("body"))))
           .when(shape == 1, F.to_json(F.struct(F.lit(200).alias("statusCode"), inner.alias("body"))))
           .otherwise(F.to_json(inner)))
    return a.select("conv_id", "turn", raw.alias("raw"))


@query("unwrap_body", O.q(ANSWERS_SQL + """
SELECT conv_id, turn, coalesce(split_part(context, chr(10), 1), '') AS answer, intent,
       coalesce(context, '') AS context, category,
       CAST(NULL AS VARCHAR) AS error FROM answers"""))
def _x13(spark, d):
    r = responses(spark, d)
    return r.select("conv_id", "turn", RT.unwrap_body(F.col("raw")).alias("b")).select("conv_id", "turn", "b.*")


@query("build_request", RAW + ROUTED + f""",
req AS (SELECT conv_id, turn, question, category,
               nullif(trim(CASE WHEN intent IN ('copurchase', 'similar_to') THEN '  {ANCHOR} ' ELSE '   ' END), '') AS pid
        FROM routed)
SELECT conv_id, turn, CASE
  WHEN pid IS NULL AND category IS NULL THEN json_object('question', question)
  WHEN pid IS NULL THEN json_object('question', question, 'category', category)
  WHEN category IS NULL THEN json_object('question', question, 'product_id', pid)
  ELSE json_object('question', question, 'product_id', pid, 'category', category) END::VARCHAR AS body
FROM req""")
def _x14(spark, d):
    r = routed_questions(spark, d).withColumn(
        "pid_text",
        F.when(F.col("intent").isin("copurchase", "similar_to"), F.lit(f"  {ANCHOR} ")).otherwise(F.lit("   ")),
    )
    return r.select("conv_id", "turn", RT.build_request(r, "question", "pid_text", "category").alias("body"))


# ── S: file sources and sinks ────────────────────────────────────────────────────────────────────────────
from pyspark.sql import types as T  # noqa: E402

from ..session import scratch_path  # noqa: E402
from ..sources import files as S  # noqa: E402
from ..sources import graph_store as GS  # noqa: E402
from ..streaming import reload as ST  # noqa: E402

CSV_HEADER = "doc_id,body,lang"
CSV_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("lang", T.StringType()),
])


def dirty_csv(spark, d) -> str:
    """Every document as one CSV record (quoted body, real line breaks inside); the record's arity is damaged
    by ``doc_id % 7``: 0 → a field short, 1 → one extra field, 2 → two extra empty fields, else intact."""
    docs = Tables(spark, d).documents
    body = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    k = F.pmod(F.col("doc_id"), F.lit(7))
    i = F.col("doc_id").cast("string")
    line = (F.when(k == 0, F.concat_ws(",", i, body))
            .when(k == 1, F.concat_ws(",", i, body, F.col("lang"), F.lit("extra")))
            .when(k == 2, F.concat_ws(",", i, body, F.col("lang"), F.lit(""), F.lit("")))
            .otherwise(F.concat_ws(",", i, body, F.col("lang"))))
    path = scratch_path(spark, "dirty-csv")
    S.write_lines_with_header(docs.select(line), CSV_HEADER, path)
    return path


@query("read_csv_tolerant", """
SELECT doc_id, text AS body, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang
FROM documents WHERE doc_id % 7 NOT IN (1, 2)""")
def _s1(spark, d):
    return S.read_csv_tolerant(spark, dirty_csv(spark, d), CSV_SCHEMA, split=True)


@query("read_csv_strict_arity", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS body, lang FROM documents WHERE doc_id % 7 NOT IN (0, 1, 2)""")
def _s2(spark, d):
    return S.read_csv_strict_arity(spark, dirty_csv(spark, d), ["doc_id", "body", "lang"], split=True)


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
    T.StructField("unused", T.StringType()),
])


@query("read_jsonl", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _s3(spark, d):
    e = Tables(spark, d).events
    etype = F.regexp_replace(F.to_json(F.array(F.col("event_type"))), r"^\[|\]$", "")
    line = F.format_string('{"event_id":%d,"event_type":%s,"props":%s,"unused":"x"}', F.col("event_id"), etype,
                           F.col("props"))
    path = scratch_path(spark, "jsonl")
    e.select(line).write.text(path)
    r = S.read_jsonl(spark, path, EVENT_SCHEMA, ["event_id", "event_type", "props"])
    return r.select("event_id", "event_type", F.col("props.k").alias("k"))


def tsv_frame(spark, d):
    """Documents cleaned by X1 for the TSV export, with a backslash after each comma (the data has none)."""
    docs = Tables(spark, d).documents
    body = F.replace(X.clean_text(F.col("text")), F.lit(", "), F.lit(",\\ "))
    return docs.select("doc_id", body.alias("body"), "lang")


TSV_BODY_SQL = f"replace({clean_sql('text')}, ', ', ',\\ ')"


@query("read_tsv", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {TSV_BODY_SQL} AS body, lang FROM documents")
def _s4(spark, d):
    path = scratch_path(spark, "tsv")
    S.write_tsv_noquote(tsv_frame(spark, d), path)
    return S.read_tsv(spark, path, ["doc_id", "body", "lang"])


@query("write_csv_quote_all", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, '"', '""') AS body, lang FROM documents""")
def _s5(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", X.double_quotes("text").alias("body"), "lang")
    path = scratch_path(spark, "csv-quoted")
    S.write_csv_quote_all(docs, path)
    return S.read_csv_strict_arity(spark, path, ["doc_id", "body", "lang"])


@query("write_tsv_noquote", f"""
SELECT CAST(doc_id AS VARCHAR) || chr(9) || regexp_replace({TSV_BODY_SQL}, '([\\\\"\\t\\r\\n])', '\\\\\\1', 'g')
       || chr(9) || lang AS line FROM documents""")
def _s6(spark, d):
    path = scratch_path(spark, "tsv-lines")
    S.write_tsv_noquote(tsv_frame(spark, d), path)
    lines = spark.read.text(path)
    return lines.filter(F.col("value") != "doc_id\tbody\tlang").select(F.col("value").alias("line"))


@query("write_graph_tables", O.q(GRAPH_PARTS_SQL.split("SELECT coalesce")[0] + """,
sums AS (
  SELECT 'Product' AS name, CAST(sum(product_id * review_count + length(coalesce(title, '')) + length(coalesce(category, ''))) AS BIGINT) AS digest FROM products
  UNION ALL SELECT 'Reviewer', CAST(sum(reviewer_id * n) AS BIGINT) FROM (SELECT reviewer_id, count(*) AS n FROM reviews GROUP BY reviewer_id)
  UNION ALL SELECT 'Category', CAST(sum(length(name)) AS BIGINT) FROM categories
  UNION ALL SELECT 'REVIEWED', CAST(sum(reviewer_id * 7 + product_id * 3 + review_id * stars) AS BIGINT) FROM reviews
  UNION ALL SELECT 'CO_PURCHASED', CAST(sum(src * 7 + dst * 3 + weight * CASE WHEN cross_cat THEN 11 ELSE 5 END) AS BIGINT) FROM co
  UNION ALL SELECT 'BELONGS_TO', CAST(sum(src * length(dst)) AS BIGINT) FROM belongs_to
  UNION ALL SELECT 'ACTIVE_IN', CAST(sum(reviewer_id * length(category) * n) AS BIGINT) FROM
    (SELECT reviewer_id, category, count(*) AS n FROM reviews WHERE category <> '' GROUP BY ALL))
SELECT p.name, p.n, s.digest FROM parts p JOIN sums s ON p.name = s.name"""))
def _s7(spark, d):
    """Counts and a content digest of every stored table, read back from storage."""
    base = scratch_path(spark, "graph")
    GS.write_graph_tables(graph(spark, d), base)
    digests = {
        "Product": F.col("product_id") * F.col("review_count") + F.length(F.coalesce("title", F.lit("")))
        + F.length(F.coalesce("category", F.lit(""))),
        "Reviewer": F.col("reviewer_id") * F.col("review_count"),
        "Category": F.length("name"),
        "REVIEWED": F.col("src") * 7 + F.col("dst") * 3 + F.col("review_id") * F.col("stars"),
        "CO_PURCHASED": F.col("src") * 7 + F.col("dst") * 3 + F.col("weight") * F.when(F.col("cross_cat"), 11).otherwise(5),
        "BELONGS_TO": F.col("src") * F.length("dst"),
        "ACTIVE_IN": F.col("src") * F.length("dst") * F.col("review_count"),
    }
    out = None
    for name in GS.LAYOUT:
        c = GS.scan(spark, base, name).agg(
            F.count(F.lit(1)).alias("n"), F.sum(digests[name].cast("bigint")).alias("digest")
        ).select(F.lit(name).alias("name"), "n", "digest")
        out = c if out is None else out.unionByName(c)
    return out


@query("write_report_counts", """
SELECT CAST(count(*) AS BIGINT) AS input,
       CAST(count(*) FILTER (WHERE doc_id % 7 NOT IN (0, 1, 2)) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE doc_id % 7 IN (0, 1, 2)) AS BIGINT) AS dropped
FROM documents""")
def _s8(spark, d):
    """The cleaning run over the dirty export; its report is taken from the run itself."""
    from ..sources import review_export as RE

    report = scratch_path(spark, "cleaning-report")
    RE.clean_reviews(spark, dirty_csv(spark, d), scratch_path(spark, "cleaned"), report, ["doc_id", "body", "lang"], split=True)
    return spark.read.schema("input long, kept long, dropped long").json(report)


@query("clean_to_graph", O.q("SELECT * FROM products"))
def _s_chain(spark, d):
    """The whole way from raw files: every review as a raw CSV record with its columns in another order (and one
    record of a wrong arity after every 50th), cleaned, reloaded and built into product nodes."""
    from ..sources import review_export as RE

    r = reviews(spark, d)

    def quoted(c):
        return F.concat(F.lit('"'), X.double_quotes(F.col(c).cast("string")), F.lit('"'))

    header = ["reviewer_id", "review_date", "product_category", "stars", "product_title", "review_id", "unused", "product_id"]
    values = [F.col("reviewer_id").cast("string"), F.col("ts").cast("string"), quoted("category"), F.col("stars").cast("string"),
              quoted("title"), F.col("review_id").cast("string"), F.lit("x"), F.col("product_id").cast("string")]
    line = F.concat_ws(",", *values)
    broken = F.when(F.pmod(F.col("review_id"), F.lit(50)) == 1, F.concat(line, F.lit("\n1,2,3"))).otherwise(line)
    raw, tsv = scratch_path(spark, "raw-reviews"), scratch_path(spark, "clean-reviews")
    S.write_lines_with_header(r.select(broken), ",".join(header), raw)
    RE.clean_reviews(spark, raw, tsv, scratch_path(spark, "clean-report"))
    loaded = RE.reviews_from_tsv(spark, tsv, "bigint")
    return build_graph(loaded, materialize=True, bot_min_reviews=BOT_TEST[0], bot_min_ratio=BOT_TEST[1]).products


# ── ST: streaming reload ─────────────────────────────────────────────────────────────────────────────────
RAW_ROW_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


@query("incremental_reload", """
WITH rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
         CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS load_no FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY load_no DESC, l_partkey, l_suppkey, l_shipdate) AS rn FROM rows)
SELECT l_orderkey * 10 + l_linenumber AS review_id, l_partkey AS product_id, l_suppkey, l_shipdate AS ts,
       CAST((CAST(floor(l_quantity - 1) AS INTEGER) % 5) + 1 AS INTEGER) AS stars
FROM r WHERE rn = 1""")
def _st1(spark, d):
    """Three deliveries – open line items, finished line items, and the finished ones again – each followed by
    an AvailableNow run; the final version must equal the batch upsert."""
    li = Tables(spark, d).lineitem
    finished = F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
    base = scratch_path(spark, "reload")
    deliveries, table, ckpt = f"{base}/deliveries", f"{base}/table", f"{base}/_checkpoint"
    schema = li.select(*RAW_ROW_COLUMNS).schema
    t = None
    for n, part in enumerate([~finished, finished, finished], start=1):
        li.filter(part).select(*RAW_ROW_COLUMNS).write.parquet(ST.delivery_path(deliveries, n))
        t = ST.run_reload(spark, deliveries, schema, table, ckpt,
                          ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])
    return t.select(
        R.review_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("review_id"),
        F.col("l_partkey").alias("product_id"), "l_suppkey", F.col("l_shipdate").alias("ts"),
        R.stars_from_quantity(F.col("l_quantity")).alias("stars"),
    )


# ── ST: graph tables kept up to date by the reload ───────────────────────────────────────────────────────
from ..streaming import graph_reload as GR  # noqa: E402

#: Three deliveries: open line items, finished ones, and once more those that were returned; the last one wins.
DELIVERED = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY load_no DESC, l_partkey, l_suppkey, l_shipdate) AS rn
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS load_no FROM lineitem)),"""
_RAW_LI = O.RAW_REVIEWS[: O.RAW_REVIEWS.index("all_reviews AS (")]


def maintained_sql(select: str) -> str:
    """The graph over the delivered reviews, without a bot filter."""
    graph_sql = O.GRAPH.replace(_RAW_LI, DELIVERED + "\n").replace(" WHERE reviewer_id NOT IN (SELECT reviewer_id FROM bots)", "")
    return graph_sql + select


@functools.lru_cache(maxsize=4)
def maintained_graph(spark, d) -> "GR.MaintainedGraph":
    """Every review in three deliveries, an AvailableNow run after each; the graph tables follow the reviews.  Built
    once a session for the queries that read them."""
    t = Tables(spark, d)
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("reviewer_id"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    rows = t.lineitem.join(o, "l_orderkey").join(p, "l_partkey").select(
        R.review_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("review_id"), "reviewer_id",
        F.col("l_partkey").alias("product_id"), "title", "category", R.stars_from_quantity(F.col("l_quantity")).alias("stars"),
        F.col("l_shipdate").alias("ts"), "l_suppkey", "l_linestatus", "l_returnflag",
    )
    rows = materialize(rows, "deliveries")
    finished = F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
    returned = F.coalesce(F.col("l_returnflag") == "A", F.lit(False))
    base = scratch_path(spark, "graph-reload")
    graph = GR.MaintainedGraph(spark, f"{base}/graph", rows.drop("l_linestatus", "l_returnflag").schema, ["product_id", "l_suppkey", "ts"])
    for n, part in enumerate([~finished, finished, returned], start=1):
        rows.filter(part).drop("l_linestatus", "l_returnflag").write.parquet(ST.delivery_path(f"{base}/deliveries", n))
        graph.reload(f"{base}/deliveries", f"{base}/_checkpoint")
    return graph


@query("maintained_products", maintained_sql("SELECT * FROM products"))
def _st_products(spark, d):
    return maintained_graph(spark, d).products()


@query("maintained_reviewers", maintained_sql("""
SELECT reviewer_id, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS DOUBLE) / count(*) AS avg_stars
FROM reviews GROUP BY reviewer_id"""))
def _st_reviewers(spark, d):
    return maintained_graph(spark, d).reviewers()


@query("maintained_co_purchased", maintained_sql("SELECT src, dst, weight, cross_cat, src_category, dst_category FROM co"))
def _st_co(spark, d):
    return maintained_graph(spark, d).co_purchased()
