"""Graph patterns as equi-joins.

Edges are ``(src, dst, props…)`` frames and nodes are keyed frames.  A directed step is an inner join on
the edge's ``src`` and ``dst``; an undirected step first unions the edge with its reverse; an optional step
is a left join.  No pattern here needs a theta or cross join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Each edge in the other direction (endpoint category columns swapped with it); self-loops dropped."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    swap = {"src_category": "dst_category", "dst_category": "src_category"}
    return edges.filter(F.col("src") != F.col("dst")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"),
        *[F.col(swap[c]).alias(c) if c in swap and swap[c] in cols else F.col(c) for c in cols],
    )


def union_directions(edges: DataFrame) -> DataFrame:
    """Each edge once as stored and once reversed; a self-loop only once.

    The edges are read once and doubled row by row: a union would work out a lazy edge table for either direction.
    """
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    swap = {"src_category": "dst_category", "dst_category": "src_category"}
    other = {"src": "dst", "dst": "src", **{c: swap[c] if c in swap and swap[c] in cols else c for c in cols}}
    stored = F.struct(*[F.col(c).alias(c) for c in edges.columns])
    back = F.struct(*[F.col(other[c]).alias(c) for c in edges.columns])
    both = F.when(F.col("src") != F.col("dst"), F.array(stored, back)).otherwise(F.array(stored))
    return edges.select(F.inline(both))


def expand(
    nodes: DataFrame, node_key: str, edges: DataFrame, targets: DataFrame, target_key: str,
    how: str = "inner", edge_alias: str = "e",
) -> DataFrame:
    """J1 (how='inner') / J4 (how='left'): ``(n)-[e]->(t)`` as two joins: n.key = e.src, e.dst = t.key."""
    e = edges.alias(edge_alias)
    step = nodes.join(e, nodes[node_key] == F.col(f"{edge_alias}.src"), how)
    return step.join(targets, F.col(f"{edge_alias}.dst") == targets[target_key], how)


def expand_undirected(nodes: DataFrame, node_key: str, edges: DataFrame, targets: DataFrame, target_key: str,
                      how: str = "inner") -> DataFrame:
    """``(n)-[e]-(t)``."""
    return expand(nodes, node_key, union_directions(edges), targets, target_key, how)


def endpoint_attributes(edges: DataFrame, products: DataFrame, belongs_to: DataFrame | None = None) -> DataFrame:
    """Attach product attributes (and BELONGS_TO categories when given) to both ends of each edge."""
    def side(suffix: str) -> DataFrame:
        p = products.select(
            F.col("product_id").alias(f"__id{suffix}"),
            F.col("title").alias(f"title{suffix}"),
            F.col("bayesian_score").alias(f"score{suffix}"),
            F.col("avg_stars").alias(f"stars{suffix}"),
            F.col("review_count").alias(f"reviews{suffix}"),
        )
        if belongs_to is not None:
            c = belongs_to.select(F.col("src").alias(f"__cid{suffix}"), F.col("dst").alias(f"category{suffix}"))
            p = p.join(c, p[f"__id{suffix}"] == c[f"__cid{suffix}"]).drop(f"__cid{suffix}")
        return p

    s1, s2 = side("1"), side("2")
    return (
        edges.join(s1, edges.src == s1.__id1)
        .join(s2, F.col("dst") == s2.__id2)
        .drop("__id1", "__id2")
    )


def optional_bound_check(rows: DataFrame, edges: DataFrame, src_col: str, dst_col: str, flag: str) -> DataFrame:
    """``OPTIONAL MATCH (a)-[:E]->(b)`` with a and b both bound: filters nothing, exposes a flag.

    Left join on both keys against the distinct edge keys – restricted first (semi join) to the sources that
    occur in ``rows``, so the work follows the size of ``rows``, not of the whole edge table.
    """
    sources = rows.select(F.col(src_col).alias("src")).distinct()
    keys = (
        edges.select("src", "dst").join(sources, "src", "left_semi")
        .select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
        .withColumn("__hit", F.lit(True))
    )
    return (
        rows.join(keys, (rows[src_col] == keys.__s) & (rows[dst_col] == keys.__d), "left")
        .withColumn(flag, F.coalesce(F.col("__hit"), F.lit(False)))
        .drop("__s", "__d", "__hit")
    )


def two_hop(purchases: DataFrame, anchor) -> DataFrame:
    """``(p {id})<-[:PURCHASED]-(c)-[:PURCHASED]->(other)`` with the two PURCHASED edges distinct.

    ``purchases``: distinct (reviewer_id, product_id).  The anchor filter is applied to one side before the
    join on the reviewer, so only the anchor's buyers are expanded.  Output: pid, reviewer_id, other_id.
    """
    a = purchases.filter(F.col("product_id") == F.lit(anchor)).select(
        F.col("product_id").alias("pid"), "reviewer_id"
    )
    b = purchases.select(F.col("reviewer_id").alias("__r"), F.col("product_id").alias("other_id"))
    return (
        a.join(b, a.reviewer_id == b.__r)
        .filter(F.col("other_id") != F.col("pid"))  # a path may not reuse its PURCHASED edge
        .select("pid", "reviewer_id", "other_id")
    )
