"""Reference SQL (DuckDB dialect) for the registered queries – the correctness oracle.

Shared CTEs spell out the canonical review mapping and the graph tables once; each query appends its own
SELECT.  Conventions: counts are cast to BIGINT (DuckDB sums are HUGEINT), truncation uses ``trunc`` (DuckDB
casts round), null order is always explicit (DuckDB sorts nulls last by default, Spark first for ASC).
"""
from __future__ import annotations

# biting bot parameters for the test data (library default: > 500 reviews, ratio > 0.95)
BOT_TEST = (40, 0.3)

# keyed upsert over the raw deliveries: first row per review key by (l_partkey, l_suppkey, l_shipdate)
RAW_REVIEWS = """
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn
  FROM lineitem),
all_reviews AS (
  SELECT li.l_orderkey * 10 + li.l_linenumber AS review_id, o.o_custkey AS reviewer_id,
         li.l_partkey AS product_id, p.p_name AS title, p.p_type AS category,
         CAST((CAST(floor(li.l_quantity - 1) AS INTEGER) % 5) + 1 AS INTEGER) AS stars,
         li.l_shipdate AS ts
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey
          JOIN part p ON li.l_partkey = p.p_partkey
  WHERE li.rn = 1)"""


def bots_cte(min_reviews: int = 500, min_ratio: float = 0.95, src: str = "all_reviews") -> str:
    return f"""
per_star AS (SELECT reviewer_id, stars, count(*) AS n FROM {src} GROUP BY reviewer_id, stars),
bot_stats AS (SELECT reviewer_id, CAST(sum(n) AS BIGINT) AS review_count, CAST(max(n) AS BIGINT) AS modal_count,
                     CAST(max(n) AS DOUBLE) / sum(n) AS ratio
              FROM per_star GROUP BY reviewer_id),
bots AS (SELECT * FROM bot_stats WHERE review_count > {min_reviews} AND ratio > {min_ratio})"""


GRAPH = (
    "WITH "
    + RAW_REVIEWS
    + ","
    + bots_cte(*BOT_TEST)
    + """,
reviews AS (SELECT * FROM all_reviews WHERE reviewer_id NOT IN (SELECT reviewer_id FROM bots)),
pstats AS (
  SELECT product_id, CAST(count(*) AS BIGINT) AS review_count, CAST(sum(stars) AS BIGINT) AS sum_stars,
         min(title) AS title, min(CASE WHEN category <> '' THEN category END) AS category
  FROM reviews GROUP BY product_id),
gmean AS (SELECT CAST(sum(sum_stars) AS DOUBLE) / sum(review_count) AS mean_stars FROM pstats),
products AS (
  SELECT product_id, title, category,
         (CAST(10 AS DOUBLE) * gmean.mean_stars + sum_stars) / (CAST(10 AS DOUBLE) + review_count) AS bayesian_score,
         CAST(sum_stars AS DOUBLE) / review_count AS avg_stars, review_count
  FROM pstats, gmean),
belongs_to AS (SELECT product_id AS src, category AS dst FROM products WHERE category IS NOT NULL),
categories AS (SELECT DISTINCT category AS name FROM reviews WHERE category IS NOT NULL AND category <> ''),
inc AS (SELECT DISTINCT reviewer_id AS g, product_id AS item FROM reviews),
pairs AS (
  SELECT a.item AS src, b.item AS dst, CAST(count(*) AS BIGINT) AS weight
  FROM inc a JOIN inc b ON a.g = b.g AND a.item < b.item
  GROUP BY a.item, b.item),
co AS (
  SELECT e.src, e.dst, e.weight, c1.dst AS src_category, c2.dst AS dst_category,
         coalesce(c1.dst <> c2.dst, false) AS cross_cat
  FROM pairs e LEFT JOIN belongs_to c1 ON e.src = c1.src LEFT JOIN belongs_to c2 ON e.dst = c2.src
  WHERE e.weight >= 2),
und AS (
  SELECT src, dst, weight FROM co
  UNION ALL SELECT dst AS src, src AS dst, weight FROM co WHERE src <> dst)
"""
)

PAIR_SELECT = """
SELECT t.p1 AS pid, a.title AS title, a.bayesian_score AS score, a.avg_stars AS stars, a.review_count AS reviews,
       t.c1 AS category, t.p2 AS pid2, b.title AS title2, b.bayesian_score AS score2, b.avg_stars AS stars2,
       b.review_count AS reviews2, t.c2 AS category2, t.weight, {cross} AS cross_cat, 'CO_PURCHASED' AS rel_type
FROM t JOIN products a ON t.p1 = a.product_id JOIN products b ON t.p2 = b.product_id"""


def q(sql: str) -> str:
    """A query over the graph CTEs."""
    return GRAPH + sql


def top_rated(min_reviews: int, k: int) -> str:
    return q(f"""
SELECT product_id AS pid, title, bayesian_score AS score, avg_stars AS stars, review_count AS reviews,
       category AS cat_name, category, 'BELONGS_TO' AS rel_type, CAST(NULL AS BIGINT) AS pid2,
       CAST(NULL AS VARCHAR) AS title2, CAST(NULL AS BIGINT) AS weight
FROM products WHERE review_count >= {min_reviews} AND category IS NOT NULL
ORDER BY bayesian_score DESC, product_id ASC LIMIT {k}""")


def top_by_category(category: str, min_reviews: int, k: int) -> str:
    return q(f"""
SELECT product_id AS pid, title, bayesian_score AS score, avg_stars AS stars, review_count AS reviews,
       category, 'BELONGS_TO' AS rel_type, CAST(NULL AS BIGINT) AS pid2,
       CAST(NULL AS VARCHAR) AS title2, CAST(NULL AS BIGINT) AS weight
FROM products WHERE category = '{category}' AND review_count >= {min_reviews}
ORDER BY bayesian_score DESC, product_id ASC LIMIT {k}""")


def copurchase_by_product(pid: int, k: int) -> str:
    return q(f""",
h AS (
  SELECT src AS p1, dst AS p2, weight, cross_cat, src_category AS c1, dst_category AS c2 FROM co WHERE src = {pid}
  UNION ALL
  SELECT dst AS p1, src AS p2, weight, cross_cat, dst_category AS c1, src_category AS c2 FROM co
  WHERE dst = {pid} AND src <> dst),
t AS (SELECT * FROM h WHERE c1 IS NOT NULL AND c2 IS NOT NULL ORDER BY weight DESC, p2 ASC LIMIT {k})
""" + PAIR_SELECT.format(cross="t.cross_cat"))


def copurchase_global(k: int, cross_only: bool = False) -> str:
    cond = "AND cross_cat" if cross_only else ""
    return q(f""",
t AS (SELECT src AS p1, dst AS p2, weight, cross_cat, src_category AS c1, dst_category AS c2 FROM co
      WHERE src_category IS NOT NULL AND dst_category IS NOT NULL {cond}
      ORDER BY weight DESC, src ASC, dst ASC LIMIT {k})
""" + PAIR_SELECT.format(cross="true" if cross_only else "t.cross_cat"))


def combined_score_rows(min_reviews: int, k: int) -> str:
    return q(f""",
tp AS (SELECT * FROM products WHERE review_count >= {min_reviews} AND category IS NOT NULL
       ORDER BY bayesian_score DESC, product_id ASC LIMIT {k})
SELECT tp.product_id AS pid, tp.title, tp.bayesian_score AS score, tp.avg_stars AS stars,
       tp.review_count AS reviews, tp.category, u.dst AS pid2, p2.title AS title2, p2.bayesian_score AS score2,
       p2.category AS category2, u.weight, 'CO_PURCHASED' AS rel_type
FROM tp LEFT JOIN und u ON tp.product_id = u.src LEFT JOIN products p2 ON u.dst = p2.product_id
ORDER BY score DESC, pid ASC, pid2 ASC NULLS FIRST LIMIT {k}""")


def combined_score_rank(min_reviews: int, k: int, alpha: float = 0.1) -> str:
    return q(f""",
deg AS (SELECT src AS product_id, CAST(count(*) AS BIGINT) AS degree FROM und GROUP BY src),
s AS (SELECT p.*, coalesce(d.degree, 0) AS degree2 FROM products p LEFT JOIN deg d ON p.product_id = d.product_id
      WHERE p.review_count >= {min_reviews} AND p.category IS NOT NULL)
SELECT product_id AS pid, title, bayesian_score AS score, CAST(degree2 AS BIGINT) AS degree,
       round(bayesian_score + {alpha} * ln(1.0 + degree2), 6) AS combined, category
FROM s ORDER BY combined DESC, product_id ASC LIMIT {k}""")


def top_n_per_category(n: int, min_reviews: int) -> str:
    return q(f""",
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY bayesian_score DESC, product_id ASC) AS rank
      FROM products WHERE category IS NOT NULL AND review_count >= {min_reviews})
SELECT category, CAST(rank AS INTEGER) AS rank, product_id AS pid, title, bayesian_score AS score,
       avg_stars AS stars, review_count AS reviews, substr(title, 1, 40) || '...' AS product_label
FROM r WHERE rank <= {n}""")


def product_neighbourhood(pid: int, k: int) -> str:
    return "WITH " + RAW_REVIEWS + f""",
pr AS (SELECT DISTINCT reviewer_id, product_id FROM all_reviews),
paths AS (SELECT a.product_id AS pid, a.reviewer_id, b.product_id AS other_id
          FROM pr a JOIN pr b ON a.reviewer_id = b.reviewer_id AND b.product_id <> a.product_id
          WHERE a.product_id = {pid}),
rv AS (SELECT product_id, review_id, reviewer_id AS author_id FROM all_reviews WHERE product_id = {pid}),
sim AS (SELECT a.product_id AS of_id, b.product_id AS sim_id, CAST(count(*) AS BIGINT) AS sim_weight
        FROM pr a JOIN pr b ON a.reviewer_id = b.reviewer_id AND b.product_id > a.product_id
        WHERE a.product_id = {pid} GROUP BY ALL)
SELECT p.pid, p.reviewer_id, p.other_id, r.review_id, coalesce(r.author_id = p.reviewer_id, false) AS wrote,
       s.sim_id, s.sim_weight
FROM paths p LEFT JOIN rv r ON p.pid = r.product_id LEFT JOIN sim s ON p.pid = s.of_id
ORDER BY p.reviewer_id, p.other_id, r.review_id ASC NULLS FIRST, s.sim_id ASC NULLS FIRST LIMIT {k}"""


# ── CTE builders for rows with a rank (subgraph assembly, retrieval contexts) ───────────────────────────
def cte_top_rated(name: str, min_reviews: int, k: int) -> str:
    return f""",
{name} AS (
  SELECT product_id AS pid, title, bayesian_score AS score, avg_stars AS stars, review_count AS reviews, category,
         row_number() OVER (ORDER BY bayesian_score DESC, product_id ASC) AS rank
  FROM products WHERE review_count >= {min_reviews} AND category IS NOT NULL
  ORDER BY bayesian_score DESC, product_id ASC LIMIT {k})"""


def cte_per_category(name: str, n: int, min_reviews: int) -> str:
    return f""",
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY bayesian_score DESC, product_id ASC) AS rank
             FROM products WHERE category IS NOT NULL AND review_count >= {min_reviews}),
{name} AS (SELECT product_id AS pid, title, bayesian_score AS score, avg_stars AS stars, review_count AS reviews,
                  category, rank FROM {name}_r WHERE rank <= {n})"""


def _pair_rows(name: str, source: str, order: str, k: int, cross: str) -> str:
    return f""",
{name}_t AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({source}) ORDER BY {order} LIMIT {k}),
{name} AS (
  SELECT t.p1 AS pid, a.title AS title, a.bayesian_score AS score, a.avg_stars AS stars, a.review_count AS reviews,
         t.c1 AS category, t.p2 AS pid2, b.title AS title2, b.bayesian_score AS score2, b.avg_stars AS stars2,
         b.review_count AS reviews2, t.c2 AS category2, t.weight, {cross} AS cross_cat, 'CO_PURCHASED' AS rel_type,
         t.rank
  FROM {name}_t t JOIN products a ON t.p1 = a.product_id JOIN products b ON t.p2 = b.product_id)"""


def cte_pairs_global(name: str, k: int, cross_only: bool = False) -> str:
    cond = "AND cross_cat" if cross_only else ""
    src = f"""SELECT src AS p1, dst AS p2, weight, cross_cat, src_category AS c1, dst_category AS c2 FROM co
              WHERE src_category IS NOT NULL AND dst_category IS NOT NULL {cond}"""
    return _pair_rows(name, src, "weight DESC, p1 ASC, p2 ASC", k, "true" if cross_only else "t.cross_cat")


def cte_pairs_anchor(name: str, pid: int, k: int) -> str:
    src = f"""SELECT * FROM (
                SELECT src AS p1, dst AS p2, weight, cross_cat, src_category AS c1, dst_category AS c2 FROM co WHERE src = {pid}
                UNION ALL
                SELECT dst, src, weight, cross_cat, dst_category, src_category FROM co WHERE dst = {pid} AND src <> dst)
              WHERE c1 IS NOT NULL AND c2 IS NOT NULL"""
    return _pair_rows(name, src, "weight DESC, p2 ASC", k, "t.cross_cat")


def cte_combined(name: str, min_reviews: int, k: int) -> str:
    return f""",
{name}_tp AS (SELECT * FROM products WHERE review_count >= {min_reviews} AND category IS NOT NULL
              ORDER BY bayesian_score DESC, product_id ASC LIMIT {k}),
{name}_all AS (
  SELECT tp.product_id AS pid, tp.title, tp.bayesian_score AS score, tp.avg_stars AS stars,
         tp.review_count AS reviews, tp.category, u.dst AS pid2, p2.title AS title2, p2.bayesian_score AS score2,
         p2.category AS category2, u.weight, 'CO_PURCHASED' AS rel_type
  FROM {name}_tp tp LEFT JOIN und u ON tp.product_id = u.src LEFT JOIN products p2 ON u.dst = p2.product_id),
{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, pid ASC, pid2 ASC NULLS FIRST) AS rank FROM {name}_all
           ORDER BY score DESC, pid ASC, pid2 ASC NULLS FIRST LIMIT {k})"""


def num_text(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DOUBLE), {places}) AS VARCHAR)"


LABELS_SQL = """CASE {c} WHEN 'Toys_and_Games' THEN '🧸 Toys' WHEN 'Sports_and_Outdoors' THEN '🏃 Sports'
  WHEN 'Video_Games' THEN '🎮 Video Games' ELSE {c} END"""


def tooltip_sql(title: str, pid: str, category: str, stars: str, score: str, reviews: str) -> str:
    name = f"(CASE WHEN {title} IS NULL OR {title} = '' THEN CAST({pid} AS VARCHAR) ELSE {title} END)"
    return (f"'📦 ' || {name} || chr(10) || '🏷️ ' || coalesce({category}, 'None') || chr(10) || '⭐ ' || "
            f"{num_text(f'coalesce({stars}, 0.0)', 2)} || ' | 📊 Score: ' || {num_text(f'coalesce({score}, 0.0)', 4)}"
            f" || chr(10) || '💬 ' || CAST(coalesce({reviews}, 0) AS VARCHAR) || ' reseñas'")


def short_title_sql(title: str, fallback: str) -> str:
    return (f"(CASE WHEN {title} IS NULL OR {title} = '' THEN CAST({fallback} AS VARCHAR) "
            f"WHEN length({title}) > 35 THEN substr({title}, 1, 35) || '...' ELSE {title} END)")


def subgraph_nodes_sql(rows: str) -> str:
    return f""",
sg_ids AS (SELECT pid AS product_id FROM {rows} WHERE pid IS NOT NULL
           UNION SELECT pid2 FROM {rows} WHERE pid2 IS NOT NULL),
sg_cats AS (SELECT category AS name FROM {rows} WHERE category IS NOT NULL AND category <> ''
            UNION SELECT category2 FROM {rows} WHERE category2 IS NOT NULL AND category2 <> ''),
sg_nodes AS (
  SELECT CAST(i.product_id AS VARCHAR) AS node_id, 'Product' AS kind, {short_title_sql('p.title', 'i.product_id')} AS label,
         {tooltip_sql('p.title', 'i.product_id', 'p.category', 'p.avg_stars', 'p.bayesian_score', 'p.review_count')} AS tooltip
  FROM sg_ids i LEFT JOIN products p ON i.product_id = p.product_id
  UNION ALL
  SELECT 'cat_' || name, 'Category', {LABELS_SQL.format(c='name')}, '📂 Categoría: ' || name FROM sg_cats)"""


def subgraph_edges_sql(rows: str) -> str:
    shown = "(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END)"
    return f""",
sg_bt AS (SELECT CAST(pid AS VARCHAR) AS src, 'cat_' || category AS dst FROM {rows}
          WHERE pid IS NOT NULL AND category IS NOT NULL AND category <> ''
          UNION SELECT CAST(pid2 AS VARCHAR), 'cat_' || category2 FROM {rows}
          WHERE pid2 IS NOT NULL AND category2 IS NOT NULL AND category2 <> ''),
sg_cp AS (SELECT *, row_number() OVER (PARTITION BY least(pid, pid2), greatest(pid, pid2) ORDER BY rank) AS rn
          FROM {rows} WHERE pid IS NOT NULL AND pid2 IS NOT NULL),
sg_edges AS (
  SELECT src, dst, 'BELONGS_TO' AS type, CAST(1 AS BIGINT) AS width, 'BELONGS_TO' AS title FROM sg_bt
  UNION ALL
  SELECT CAST(pid AS VARCHAR), CAST(pid2 AS VARCHAR), 'CO_PURCHASED', CAST(least({shown}, 10) AS BIGINT),
         'CO_PURCHASED' || chr(10) || 'Peso: ' || CAST({shown} AS VARCHAR) FROM sg_cp WHERE rn = 1)"""


def clean_title_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[|\\r\\n]', ' ', 'g')"


def line_sql(pairs: bool) -> str:
    base = (f"'Título: ' || {clean_title_sql('title')} || ' | Score bayesiano: ' || {num_text('score', 2)} || "
            f"' | Avg stars: ' || {num_text('stars', 2)} || ' | Reviews: ' || CAST(reviews AS VARCHAR)")
    if pairs:
        base += (f" || ' | Co-compra: ' || {clean_title_sql('title2')} || ' | Peso: ' || "
                 "coalesce(CAST(weight AS VARCHAR), '')")
    return base


def contexts_cte(min_reviews: int, min_reviews_category: int, k_top=15, k_pairs=10, k_aff=20, k_comb=10) -> str:
    return (
        cte_top_rated("ctx_top", min_reviews, k_top)
        + cte_per_category("ctx_cat", k_top, min_reviews_category)
        + cte_pairs_global("ctx_co", k_pairs)
        + cte_pairs_global("ctx_aff", k_aff, cross_only=True)
        + cte_combined("ctx_comb", min_reviews, k_comb)
        + f""",
ctx_lines AS (
  SELECT 'top_rated' AS intent, CAST(NULL AS VARCHAR) AS category, rank, {line_sql(False)} AS line FROM ctx_top
  UNION ALL SELECT 'generic', NULL, rank, {line_sql(False)} FROM ctx_top
  UNION ALL SELECT 'top_by_category', category, rank, {line_sql(False)} FROM ctx_cat
  UNION ALL SELECT 'copurchase', NULL, rank, {line_sql(True)} FROM ctx_co
  UNION ALL SELECT 'similar_to', NULL, rank, {line_sql(True)} FROM ctx_co
  UNION ALL SELECT 'category_affinity', NULL, rank, {line_sql(True)} FROM ctx_aff
  UNION ALL SELECT 'combined_score', NULL, rank, {line_sql(True)} FROM ctx_comb),
contexts AS (SELECT intent, category, string_agg(line, chr(10) ORDER BY rank) AS context
             FROM ctx_lines GROUP BY intent, category)"""
    )


EXAMPLES_SQL = """['¿Cuáles son los productos mejor valorados?', '¿Cuáles son los mejores juguetes?',
  '¿Qué productos de deportes son los más valorados?', '¿Cuáles son los mejores videojuegos?',
  '¿Qué productos se compran juntos habitualmente?', '¿Qué categorías tienen más afinidad entre sí?',
  '¿Cuál es el mejor producto más popular overall?']"""


def routed_cte(category_map: dict) -> str:
    cat = " ".join(f"WHEN lower(question) LIKE '%{w}%' THEN '{v}'" for w, v in category_map.items())
    return f""",
questions AS (
  SELECT conv_id, turn, concat_ws(' ', {EXAMPLES_SQL}[((conv_id + turn) % 7) + 1], text) AS question
  FROM conversations WHERE role = 'user'),
routed0 AS (
  SELECT *, CASE
      WHEN lower(question) LIKE '%afinidad%' THEN 'category_affinity'
      WHEN lower(question) LIKE '%se compran juntos%' THEN 'copurchase'
      WHEN lower(question) LIKE '%similar%' THEN 'similar_to'
      WHEN lower(question) LIKE '%overall%' THEN 'combined_score'
      WHEN lower(question) LIKE '%combinad%' THEN 'combined_score'
      WHEN lower(question) LIKE '%juguete%' OR lower(question) LIKE '%deporte%' OR lower(question) LIKE '%videojuego%'
        THEN 'top_by_category'
      WHEN lower(question) LIKE '%mejor%' THEN 'top_rated'
      ELSE 'generic' END AS intent,
    CASE {cat} END AS cat0
  FROM questions),
routed AS (SELECT conv_id, turn, question, intent,
                  CASE WHEN intent = 'top_by_category' THEN cat0 END AS category FROM routed0)"""
