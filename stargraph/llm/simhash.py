"""SimHash near-duplicates: pigeonhole blocks, a join on block keys, Hamming check, connected components.

``fingerprints``   one 64-bit SimHash per document (words ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text,
                   ``shingle`` words joined by a space, XXH64 with seed 42; a bit is set when over half of the
                   shingle hashes have it).  Fewer words than the shingle: the whole sequence is one shingle.
                   No words (empty or null text): fingerprint zero, linked like any other.
``links``          all pairs of different fingerprints at ``max_bits`` or fewer differing bits.  The 64 bits are
                   split into ``blocks`` blocks; a close pair agrees on at least ``blocks - max_bits`` of them,
                   so every choice of that many blocks is one join key.  A pair is reported for the first
                   choice on which it agrees, hence once.
``components``     smallest document id reachable over links, per fingerprint.

Copies share a fingerprint and are collapsed before anything is joined, so a group of copies costs one row
however large it is.  All steps are joins and partial aggregates over fingerprints; nothing is collected.

Nulls: a null text is an empty text; a null ``doc_id`` takes part (its links count) but never names a
component unless the whole component has null ids.  Repeated rows keep their multiplicity.  Extra columns of
the input are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargraph.llm.common import by_value, materialize, text_or_empty

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 6
NO_ID = -(1 << 63)  # stands for a null doc_id in join keys

_SLICE = 1 << 16  # shingles hashed and counted at a time
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def _add_bits(hashes: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts[j]`` how many hashes have bit ``j``: eight byte-wide counters per word, 255 rows at most."""
    for at in range(0, len(hashes), 255):
        lanes = ((hashes[None, at : at + 255] >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64)
        counts += lanes.astype("<u8").view(np.uint8).reshape(8, 8).T.ravel()


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly ``[\\x20\\x09-\\x0D]+``.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : at + _SLICE], ends[at : at + _SLICE])
        _add_bits(np.array([digest(line[i:j], SEED) for i, j in spans], dtype=np.uint64), counts)
    return sum(1 << bit for bit in np.flatnonzero(counts * 2 > n).tolist())


def text_hash() -> Column:
    return F.xxhash64(text_or_empty(F.col("text")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint's bits as a signed long), one row per input row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = np.fromiter((simhash(t.as_py(), shingle) for t in texts), dtype=np.uint64)
            signed = pa.array(prints.view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), signed], schema=schema)

    return source.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``a, b`` (a < b): all pairs of the distinct values of ``prints.fp`` within ``max_bits`` bits."""
    if not max_bits < blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    masks = [_signed(sum(c)) for c in combinations(_block_masks(blocks), blocks - max_bits)]
    keyed = (
        prints.select("fp")
        .distinct()
        .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    )
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # the first mask on which the pair agrees is the one that reports it
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(m)) for m in masks])
    return left.join(
        right,
        (left["key"] == right["key"])
        & (left["mask"] == right["mask"])
        & (F.col("a") < F.col("b"))
        & (F.bit_count(differ) <= max_bits)
        & (first == left["mask"]),
    ).select("a", "b")


def components(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fp, component_id``: the smallest doc_id of all fingerprints reachable over ``pairs`` (itself included).

    Rounds of (a) take the smallest label of the neighbours, (b) jump to the label's own label, each over
    written tables, until no label changes.  Labels are (smallest doc_id, fingerprint that holds it), and only
    fingerprints that have a link take part.
    """
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = materialize(
        pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
            pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
        ),
        "simhash-edges",
    )
    nulls_last = F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp"))
    labels = materialize(
        edges.select(F.col("src").alias("fp")).distinct().join(own, "fp").select("fp", nulls_last.alias("label")),
        "simhash-labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("fp").alias("dst"), F.col("label").alias("seen")), "dst")
            .groupBy(F.col("src").alias("fp"))
            .agg(F.min("seen").alias("seen"))
        )
        lower = materialize(
            labels.join(near, "fp").select("fp", F.col("label").alias("old"), F.least("label", "seen").alias("label")),
            "simhash-near",
        )
        jump = lower.select(F.col("fp").alias("root"), F.col("label").alias("far"))
        labels = materialize(
            lower.join(jump, F.col("label.fp") == F.col("root")).select(
                "fp", "old", F.least("label", "far").alias("label")
            ),
            "simhash-labels",
        )
        if labels.filter(~F.col("old").eqNullSafe(F.col("label"))).isEmpty():
            break
    linked = labels.select("fp", F.col("label.low").alias("reached"))
    return own.join(linked, "fp", "left").select(
        "fp", F.when(F.col("reached").isNull(), F.col("low")).otherwise(F.col("reached")).alias("component_id")
    )


def grouped(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS
) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` per document."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    # written, so that the join below has a shuffle on both sides and AQE can split a fingerprint with many copies
    reached = materialize(components(prints, links(prints, max_bits, blocks)), "simhash-components")
    return prints.join(reached, "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS
) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits)``, component_id`` per document."""
    return grouped(docs, shingle, max_bits, blocks).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """The documents that name their group, all columns kept: one per group.

    Of rows that share that doc_id, the one with the smallest text hash stays; of those the one with the smallest
    digest of the other columns, and of equal rows one.  A group of nothing but null ids has no name; its different
    texts all stay.
    """
    named = grouped(docs, shingle, max_bits, blocks).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    nameless = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    stay = named.groupBy("doc_id", nameless.alias("nameless")).agg(F.min("text_hash").alias("_sh_text")).select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_sh_id"), "_sh_text"
    )
    keyed = docs.withColumn("_sh_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    keyed = keyed.withColumn("_sh_text", text_hash())
    kept = keyed.join(stay, ["_sh_id", "_sh_text"], "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.md5(F.to_json(F.struct(*others))) if others else F.lit("")
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), tie)
    return kept.groupBy("_sh_id", "_sh_text").agg(row.alias("_sh_row")).select("_sh_row.*")


by_value(__name__)
