"""Near-duplicate classes by 64-bit SimHash, with pigeonring filtering of the candidates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import connected_components, cut, few, map_batches, texts, whole_row

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Up to so many fingerprints of a bucket are compared in pairs; more are linked through one-bit neighbours.
PAIRED = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], ">u8"))


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if it is set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8", copy=False).view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], ["doc_id", "text_hash", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return map_batches(docs, run, "doc_id long, text_hash long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def ring_masks(segments: int) -> list[list[int]]:
    """masks[i][l-1]: the bits (signed) of the l consecutive segments from segment i on, around the ring."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    one = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(segments)]
    rows = []
    for i in range(segments):
        mask, row = 0, []
        for step in range(segments):
            mask |= one[(i + step) % segments]
            row.append(mask - (1 << 64) if mask >> 63 else mask)
        rows.append(row)
    return rows


def _bits(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask).cast("long")))


def _viable(x: Column, masks: list[list[int]], max_distance: int, shortest: int) -> Column:
    """True if every chain of ``shortest`` segments or more from segment ``i`` on has its share of ``max_distance`` or fewer of the bits of ``x``."""
    viable = F.lit(False)
    for i, row in enumerate(masks):
        chain = F.col("i") == i
        for length in range(shortest, len(masks) + 1):
            chain = chain & (_bits(x, row[length - 1]) <= length * max_distance // len(masks))
        viable = viable | chain
    return viable


def links(nodes: DataFrame, max_distance: int = 2, segments: int = 7) -> DataFrame:
    """Edges (a, b) that join any two of the distinct fingerprints ``nodes.fp`` within ``max_distance``.

    Pigeonring principle: if two fingerprints differ in t bits at most, then from some segment on every chain
    of l consecutive segments differs in floor(l * t / segments) bits at most. The chains with a budget of 0
    are the bucket key (equality, so a hash join); the longer ones prune a bucket's pairs, and the chain of
    all segments is the full Hamming distance. Buckets of more than PAIRED fingerprints give no pairs: their
    members are linked where they share a one-bit neighbour, which holds for exactly those within two bits,
    in 65 rows a fingerprint. There the edges are a star for each neighbour, so reachability is the same.
    """
    if max_distance == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if max_distance > 2 or segments <= max_distance:
        raise ValueError("max_distance is 0, 1 or 2, and segments exceed it")
    equal = math.ceil(segments / max_distance) - 1
    masks = ring_masks(segments)
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m[equal - 1]).cast("long")).alias("key")) for i, m in enumerate(masks)])
        ).alias("at"),
    ).select("at.i", "at.key", "fp")
    sizes = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["i", "key"]))
    pair = shared.where(f"n <= {PAIRED}")
    viable = _viable(F.col("a").bitwiseXOR(F.col("b")), masks, max_distance, equal + 1)
    paired = (
        pair.select("i", "key", F.col("fp").alias("a"))
        .join(pair.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
        .where((F.col("a") < F.col("b")) & viable)
        .select("a", "b")
    )
    near = shared.where(f"n > {PAIRED}").select("fp").distinct()
    one_bit = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    met = near.select("fp", F.explode(F.array(*one_bit)).alias("c")).groupBy("c").agg(F.collect_list("fp").alias("g")).where("size(g) > 1")
    if max_distance == 1:
        star = met.where("array_contains(g, c)").select(F.col("c").alias("a"), F.explode("g").alias("b"))
    else:
        star = met.select(F.array_min("g").alias("a"), F.explode("g").alias("b"))
    return paired.unionByName(star.where("a <> b")).distinct()


def wide_pairs(nodes: DataFrame, max_distance: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of ``nodes`` (node, fp) within ``max_distance``, and the crowded buckets (i, key, node): any such pair is in one or the other.

    Pigeonring principle as in ``links``, for distances at which no chain must be equal: a chain's first segment has
    one differing bit at most. So a bucket is a segment's value, with the nodes that have it and those that are one
    bit from it, in 64 rows and one more for each segment; longer chains prune the pairs of one of the former with one of the
    latter. Buckets whose value more than PAIRED nodes have give no pairs.
    """
    if not 0 < max_distance < 2 * segments:
        raise ValueError("max_distance is under two bits a segment")
    masks = ring_masks(segments)

    def rows(flipped: bool) -> DataFrame:
        keys = []
        for i, row in enumerate(masks):
            own = F.col("fp").bitwiseAND(F.lit(row[0]).cast("long"))
            flips = [1 << k for k in range(64) if flipped and row[0] >> k & 1]
            keys += [F.struct(F.lit(i).alias("i"), own.bitwiseXOR(F.lit(f - (1 << 64) if f >> 63 else f).cast("long")).alias("key")) for f in (0, *flips)]
        return nodes.select("node", "fp", F.explode(F.array(*keys)).alias("at")).select("at.i", "at.key", "node", "fp")

    crowds = few(rows(False).groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {PAIRED}").select("i", "key"))
    one = rows(False).join(crowds, ["i", "key"], "left_anti").select("i", "key", F.col("node").alias("a"), F.col("fp").alias("x"))
    two = rows(True).select("i", "key", F.col("node").alias("b"), F.col("fp").alias("y"))
    viable = _viable(F.col("x").bitwiseXOR(F.col("y")), masks, max_distance, 1)
    pairs = one.join(two, ["i", "key"]).where((F.col("a") < F.col("b")) & viable).select("a", "b").distinct()
    return pairs, rows(True).join(crowds, ["i", "key"], "left_semi").select("i", "key", "node")


def simhash_components(docs: DataFrame, shingle: int = 3, max_distance: int = 2, segments: int = 7) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the least doc_id reachable over links) of every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows come back as often as they
    stand there. A null doc_id takes part and never becomes a component's id, unless no other is there.
    Copies are one node: links are sought between distinct fingerprints alone.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = cut(links(nodes.select("fp"), max_distance, segments))
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    near = nodes.join(roots, "fp")
    least = near.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    label = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return prints.join(label, "fp").select("doc_id", "text_hash", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(docs: DataFrame, shingle: int = 3, max_distance: int = 2, segments: int = 7) -> DataFrame:
    """One row of ``docs`` for each class of near fingerprints, chosen by ``representatives``."""
    return representatives(docs, cut(simhash_components(docs, shingle, max_distance, segments).where("doc_id is not null")))


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of ``found`` (doc_id, text_hash, component_id): that of the least doc_id, then of the least text hash.

    Rows that repeat it (doc_id and text) are one, that of the least JSON. Rows without a doc_id are left alone:
    none can be named as a copy of another. Classes are found on (doc_id, text hash) alone; texts are shuffled,
    by that key, only if the keys to drop are more than MOST_KEYS.
    """
    best = cut(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")))
    gone = found.join(best, "component_id").where(F.struct("doc_id", "text_hash") != F.col("best")).select("doc_id", "text_hash").distinct()
    again = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    gone, again = few(gone), few(again)
    row = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"))
    key = ["doc_id", "text_hash"]
    kept = row.join(gone, key, "left_anti")
    if not again.isEmpty():
        twice = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(again, key, "left_anti").select("row").unionByName(twice.select("row"))
    return kept.select("row.*")
