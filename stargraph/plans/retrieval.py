"""Retrieval over tables of questions (R1–R3) and the text formats around it.

The reference answers one question per HTTP call; here a whole table of questions is routed, joined to the
context text of its intent, and the request / response JSON bodies are built and read with built-in
functions.  The language-model call itself is not part of this library.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, num_text, strip, table_title
from ..operators.graph import ReviewGraph
from . import intents as Q

# Fixed values ──────────────────────────────────────────────────────────────────────────────────────────
# Routing words, in priority order (our rule set; the reference's router is not in its tree).
ROUTES = [
    ("afinidad", "category_affinity"),
    ("se compran juntos", "copurchase"),
    ("similar", "similar_to"),
    ("overall", "combined_score"),
    ("combinad", "combined_score"),
]
CATEGORY_WORDS = ["juguete", "deporte", "videojuego"]
TOP_RATED_WORD = "mejor"
DEFAULT_CATEGORY_MAP = {"juguete": "Toys_and_Games", "deporte": "Sports_and_Outdoors", "videojuego": "Video_Games"}
# The seven example questions of the reference UI, in its order.
EXAMPLE_QUESTIONS = [
    "¿Cuáles son los productos mejor valorados?",
    "¿Cuáles son los mejores juguetes?",
    "¿Qué productos de deportes son los más valorados?",
    "¿Cuáles son los mejores videojuegos?",
    "¿Qué productos se compran juntos habitualmente?",
    "¿Qué categorías tienen más afinidad entre sí?",
    "¿Cuál es el mejor producto más popular overall?",
]
# Context line keys (the UI parser reads them back).
K_TITLE, K_SCORE, K_STARS, K_REVIEWS = "Título", "Score bayesiano", "Avg stars", "Reviews"
K_TITLE2, K_WEIGHT = "Co-compra", "Peso"
LINE_SEP = " | "
NA = "N/A"
RESPONSE_SCHEMA = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("error", T.StringType()),
])


# ── R1 ───────────────────────────────────────────────────────────────────────────────────────────────────
def route_intent(questions: DataFrame, text_col: str = "question",
                 category_map: Mapping[str, str] = DEFAULT_CATEGORY_MAP) -> DataFrame:
    """Adds ``intent`` and ``category`` (only for top_by_category) from ordered keyword rules on the
    lower-cased whole question."""
    t = F.lower(F.col(text_col))
    intent: Column | None = None
    cat: Column | None = None

    def add(cond, value):
        nonlocal intent
        intent = F.when(cond, F.lit(value)) if intent is None else intent.when(cond, F.lit(value))

    for word, name in ROUTES:
        add(t.contains(word), name)
    for word in CATEGORY_WORDS:
        cond = t.contains(word)
        add(cond, "top_by_category")
        cat_v = F.lit(category_map.get(word))
        cat = F.when(cond, cat_v) if cat is None else cat.when(cond, cat_v)
    add(t.contains(TOP_RATED_WORD), "top_rated")
    intent = intent.otherwise(F.lit("generic"))
    return questions.withColumn("intent", intent).withColumn(
        "category", F.when(F.col("intent") == "top_by_category", cat).cast("string")
    )


# ── R2 / X12 ─────────────────────────────────────────────────────────────────────────────────────────────
def _clean_title(c: Column) -> Column:
    """A title safe inside one context line: no pipe, CR or LF."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[|\r\n]", " ")


def context_line(title, score, stars, reviews, title2=None, weight=None) -> Column:
    parts = [
        F.concat(F.lit(K_TITLE + ": "), _clean_title(F.col(title))),
        F.concat(F.lit(K_SCORE + ": "), num_text(F.col(score), 2)),
        F.concat(F.lit(K_STARS + ": "), num_text(F.col(stars), 2)),
        F.concat(F.lit(K_REVIEWS + ": "), F.col(reviews).cast("string")),
    ]
    if title2 is not None:
        parts.append(F.concat(F.lit(K_TITLE2 + ": "), _clean_title(F.col(title2))))
    if weight is not None:
        parts.append(F.concat(F.lit(K_WEIGHT + ": "), F.coalesce(F.col(weight).cast("string"), F.lit(""))))
    return F.concat_ws(LINE_SEP, *parts)


def build_context(lines: DataFrame, group_cols: list[str], rank_col: str = "rank", line_col: str = "line") -> DataFrame:
    """R2: one context text per group, lines in rank order joined by newlines.

    Each group is a top-k result (≤ k lines), so collecting its lines is bounded.
    """
    return lines.groupBy(*group_cols).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(line_col).alias("l")))),
                        lambda x: x["l"]),
            "\n",
        ).alias("context")
    )


def intent_contexts(g: ReviewGraph, min_reviews: int = 5, min_reviews_category: int = 3,
                    k_top: int = 15, k_pairs: int = 10, k_affinity: int = 20, k_combined: int = 10) -> DataFrame:
    """Context text per (intent, category) from the intent queries: top_rated / generic, top_by_category for
    every category (one pass), copurchase and similar_to (global pairs), category_affinity, combined_score.
    Output: intent, category, context."""
    def simple(df: DataFrame, intent: str, order) -> DataFrame:
        from pyspark.sql import Window
        return df.select(
            F.lit(intent).alias("intent"), F.lit(None).cast("string").alias("category"),
            F.row_number().over(Window.orderBy(*order)).alias("rank"),
            context_line("title", "score", "stars", "reviews").alias("line"),
        )

    top = Q.top_rated(g, min_reviews, k_top)
    order = [F.col("score").desc(), F.col("pid").asc()]
    per_cat = Q.top_n_per_category(g, k_top, min_reviews_category).select(
        F.lit("top_by_category").alias("intent"), "category", "rank",
        context_line("title", "score", "stars", "reviews").alias("line"),
    )

    def pairs(df: DataFrame, intent: str) -> DataFrame:
        return df.select(
            F.lit(intent).alias("intent"), F.lit(None).cast("string").alias("category"), "rank",
            context_line("title", "score", "stars", "reviews", "title2", "weight").alias("line"),
        )

    co = Q.copurchase_global(g, k_pairs, with_rank=True)
    lines = (
        simple(top, "top_rated", order)
        .unionByName(simple(top, "generic", order))
        .unionByName(per_cat)
        .unionByName(pairs(co, "copurchase"))
        .unionByName(pairs(co, "similar_to"))
        .unionByName(pairs(Q.category_affinity_edges(g, k_affinity, with_rank=True), "category_affinity"))
        .unionByName(pairs(Q.combined_score_rows(g, min_reviews, k_combined, with_rank=True), "combined_score"))
    )
    return build_context(lines, ["intent", "category"])


def parse_context(contexts: DataFrame, context_col: str = "context", keep: list[str] | None = None) -> DataFrame:
    """Context text → one row per product line (lines containing ``Título:`` and ``Score``).

    Each line is split on the pipe, each part at its *first* colon; keys and values are trimmed; a repeated
    key keeps its last value; a missing key reads ``N/A``.  Output: keep…, line_no, product, score, stars, reviews.
    """
    keep = keep or []
    lines = contexts.select(*keep, F.posexplode(F.split(F.col(context_col), "\n")).alias("line_no", "line"))
    lines = lines.filter(F.col("line").contains(K_TITLE + ":") & F.col("line").contains("Score"))
    parts = F.transform(
        F.split(F.col("line"), "[|]"),
        lambda p: F.struct(
            strip(F.regexp_extract(p, "^([^:]*)", 1)).alias("k"),
            strip(F.regexp_extract(p, "(?s)^[^:]*:(.*)$", 1)).alias("v"),
        ),
    )

    def value(key: str) -> Column:
        hits = F.filter(F.col("__parts"), lambda s: s["k"] == F.lit(key))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(NA))

    return lines.withColumn("__parts", parts).select(
        *keep, "line_no",
        table_title(value(K_TITLE)).alias("product"),
        value(K_SCORE).alias("score"),
        value(K_STARS).alias("stars"),
        value(K_REVIEWS).alias("reviews"),
    )


# ── R3 ───────────────────────────────────────────────────────────────────────────────────────────────────
PAIR_INTENTS = ("copurchase", "similar_to")
SERVED_INTENTS = ("top_rated", "generic", "top_by_category", "category_affinity", "combined_score", *PAIR_INTENTS)


def entity_contexts(g: ReviewGraph, ids: DataFrame, k: int = 15) -> DataFrame:
    """The co-purchase context of every product id in ``ids.item``: ``item, context``, for ids that have neighbours.

    The edges of all ids are fetched at once (``ReviewGraph.anchored_edges``) and ranked per id with a group limit.
    """
    from pyspark.sql import Window

    per_item = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst").asc())
    top = (
        g.anchored_edges(ids.select("item"))
        .filter(F.col("src_category").isNotNull() & F.col("dst_category").isNotNull())
        .withColumn("rank", F.row_number().over(per_item))
        .filter(F.col("rank") <= F.lit(k))
        .select("src", "dst", "weight", "rank")
    )
    p = g.products
    one = p.select(
        F.col("product_id").alias("__p1"), "title", F.col("bayesian_score").alias("score"),
        F.col("avg_stars").alias("stars"), F.col("review_count").alias("reviews"),
    )
    two = p.select(F.col("product_id").alias("__p2"), F.col("title").alias("title2"))
    rows = top.join(one, F.col("src") == F.col("__p1")).join(two, F.col("dst") == F.col("__p2"))
    lines = rows.select(
        F.col("src").alias("item"), "rank",
        context_line("title", "score", "stars", "reviews", "title2", "weight").alias("line"),
    )
    return build_context(lines, ["item"])


def answer_contexts(routed: DataFrame, contexts: DataFrame, g: ReviewGraph | None = None) -> DataFrame:
    """Every routed question with its context.

    A pair intent (``copurchase``, ``similar_to``) with a ``product_id`` gets that product's neighbours (empty text
    if it has none; needs ``g``).  Every other question is joined to the context of its (intent, category), after
    the fallback of the dispatch: a category question without a category, or an intent that no query serves, reads
    the top rated products.  The context tables are small next to the questions.
    """
    served = F.col("intent").isin(*SERVED_INTENTS) & ~((F.col("intent") == "top_by_category") & F.col("category").isNull())
    of = routed.select(
        *routed.columns,
        F.when(F.coalesce(served, F.lit(False)), F.col("intent")).otherwise(F.lit("top_rated")).alias("__want"),
        F.when(F.col("intent") == "top_by_category", F.col("category")).alias("__cat"),
    )
    c = contexts.select(F.col("intent").alias("__i"), F.col("category").alias("__c"), "context")
    general = of.join(c, (F.col("__want") == F.col("__i")) & F.col("__cat").eqNullSafe(F.col("__c")), "left")
    general = general.drop("__i", "__c", "__want", "__cat")
    if g is None or "product_id" not in routed.columns:
        return general
    named = F.col("intent").isin(*PAIR_INTENTS) & F.col("product_id").isNotNull()
    ids = routed.filter(named).select(F.col("product_id").alias("item")).distinct()
    near = entity_contexts(g, ids).select("item", F.col("context").alias("__near"))
    return general.join(near, F.col("product_id") == F.col("item"), "left").select(
        *routed.columns,
        F.when(F.coalesce(named, F.lit(False)), F.coalesce(F.col("__near"), F.lit(""))).otherwise(F.col("context")).alias("context"),
    )


# ── X13 / X14 ────────────────────────────────────────────────────────────────────────────────────────────
def build_request(df: DataFrame, question: str = "question", product_id: str | None = None,
                  category: str | None = None) -> Column:
    """The request body: ``question``, the trimmed ``product_id`` unless blank, ``category`` unless empty
    (``to_json`` leaves null fields out)."""
    fields = [F.col(question).alias("question")]
    if product_id is not None:
        fields.append(blank_to_null(F.col(product_id).cast("string")).alias("product_id"))
    if category is not None:
        fields.append(F.nullif(F.col(category), F.lit("")).alias("category"))
    return F.to_json(F.struct(*fields))


def unwrap_body(raw: Column) -> Column:
    """A gateway response → struct(answer, intent, context, category, error).

    Uses ``body`` when present (an object, or a JSON string holding one), else the whole object;
    the intent defaults to ``generic``, and without an error ``answer`` and ``context`` default to empty text.
    """
    body = F.coalesce(F.get_json_object(raw, "$.body"), raw)
    s = F.from_json(body, RESPONSE_SCHEMA)
    return F.struct(
        F.when(s["error"].isNull(), F.coalesce(s["answer"], F.lit(""))).otherwise(s["answer"]).alias("answer"),
        F.coalesce(s["intent"], F.lit("generic")).alias("intent"),
        F.when(s["error"].isNull(), F.coalesce(s["context"], F.lit(""))).otherwise(s["context"]).alias("context"),
        s["category"].alias("category"),
        s["error"].alias("error"),
    )


def question_table(conversations: DataFrame) -> DataFrame:
    """Questions from conversation user turns: one of the seven example questions (chosen by conversation and
    turn) followed by the whole turn text.  Output: conv_id, turn, question."""
    examples = F.array(*[F.lit(q) for q in EXAMPLE_QUESTIONS])
    pick = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(EXAMPLE_QUESTIONS))).cast("int") + 1
    return conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.concat_ws(" ", F.element_at(examples, pick), F.col("text")).alias("question")
    )
