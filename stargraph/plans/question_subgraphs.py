"""Subgraphs for a whole table of questions (Q9 and G1 to G3 at once).

The dispatch becomes a key per question: which intent's rows it reads, for which category or product.  Questions share
keys, so rows, nodes and edges are made once per key, with the key as a group column, however many questions ask.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import ReviewGraph
from ..session import materialize
from . import intents as Q
from .retrieval import PAIR_INTENTS
from .subgraph import subgraph_edges, subgraph_nodes, subgraph_summary

KEYS = ["want", "of_category", "of_product"]
ROW = ["rank", "pid", "category", "pid2", "category2", "weight"]
OF_PRODUCT = "copurchase_of_product"


def with_keys(questions: DataFrame) -> DataFrame:
    """``questions`` (intent, category, product_id) with the dispatch's key: the branches of Q9, in its order."""
    intent = F.col("intent")
    want = (
        F.when(intent.isin(*PAIR_INTENTS) & F.col("product_id").isNotNull(), F.lit(OF_PRODUCT))
        .when(intent.isin(*PAIR_INTENTS), F.lit("copurchase"))
        .when(intent == "category_affinity", intent)
        .when((intent == "top_by_category") & F.col("category").isNotNull() & (F.col("category") != ""), intent)
        .when(intent == "combined_score", intent)
        .otherwise(F.lit("top_rated"))
    )
    keyed = questions.withColumn("want", want)
    return keyed.withColumn("of_category", F.when(F.col("want") == "top_by_category", F.col("category"))).withColumn(
        "of_product", F.when(F.col("want") == OF_PRODUCT, F.col("product_id"))
    )


def _rows(df: DataFrame, want: str, product_type, of_category=None, of_product=None) -> DataFrame:
    missing = {"pid2": product_type, "category2": "string", "weight": "long"}
    columns = [F.col(c) if c in df.columns else F.lit(None).cast(missing[c]).alias(c) for c in ROW]
    return df.select(
        F.lit(want).alias("want"), (F.lit(None) if of_category is None else F.col(of_category)).cast("string").alias("of_category"),
        (F.lit(None) if of_product is None else F.col(of_product)).cast(product_type).alias("of_product"), *columns,
    )


def key_rows(g: ReviewGraph, ids: DataFrame, k: int = 15) -> DataFrame:
    """Query rows of every key: all general intents, every category, and the products in ``ids.item``."""
    kind = g.products.schema["product_id"].dataType
    general = {name: Q.subgraph_rows(g, name)[1] for name in ("top_rated", "copurchase", "category_affinity", "combined_score")}
    out = _rows(Q.top_n_per_category(g, k, 3), "top_by_category", kind, of_category="category")
    for name, df in general.items():
        out = out.unionByName(_rows(df, name, kind))
    edges = g.anchored_edges(ids.select("item")).filter(F.col("src_category").isNotNull() & F.col("dst_category").isNotNull())
    # ranked per product with a limit before the shuffle: a product with many neighbours ships k rows a task
    per_item = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst").asc())
    near = edges.withColumn("rank", F.row_number().over(per_item)).filter(F.col("rank") <= F.lit(k)).select(
        F.col("src").alias("pid"), F.col("src_category").alias("category"), F.col("dst").alias("pid2"),
        F.col("dst_category").alias("category2"), "weight", "rank",
    )
    return out.unionByName(_rows(near, OF_PRODUCT, kind, of_product="pid"))


def question_subgraphs(g: ReviewGraph, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed questions, and the nodes (G1) and edges (G2) of every key."""
    keyed = with_keys(questions)
    ids = keyed.filter(F.col("of_product").isNotNull()).select(F.col("of_product").alias("item")).distinct()
    rows = materialize(key_rows(g, ids), "question-rows")
    return keyed, subgraph_nodes(rows, g.products, keys=KEYS), subgraph_edges(rows, keys=KEYS)


def question_summary(g: ReviewGraph, questions: DataFrame) -> DataFrame:
    """Every question with the nodes and relationships of its subgraph (G3); 0 where nothing is found."""
    keyed, nodes, edges = question_subgraphs(g, questions)
    counts = subgraph_summary(nodes, edges, KEYS).select(*[F.col(k).alias(f"__{k}") for k in KEYS], "nodes", "relationships")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
    zero = F.lit(0).cast("long")
    return keyed.join(counts, same, "left").select(
        *questions.columns, F.coalesce("nodes", zero).alias("nodes"), F.coalesce("relationships", zero).alias("relationships")
    )
