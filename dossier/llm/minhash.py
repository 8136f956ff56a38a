"""Near-duplicate classes by exact Jaccard similarity of word shingles; candidates by SimHash with pigeonring chains, and by MinHash bands beyond its distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import connected_components, cut, few, map_batches, stored, texts
from dossier.llm.simhash import LOWER, majority, representatives, text_hash, wide_pairs

#: Two texts are near if the Jaccard similarity of their shingles is NEAR[0] / NEAR[1] or more.
SHINGLE, NEAR = 5, (4, 5)
#: Sets are candidates if their fingerprints differ in BITS bits at most, found by the chains of SEGMENTS segments.
BITS, SEGMENTS = 5, 3
#: Texts meet too if all ROWS values of one of BANDS bands agree: at 0.8, all but (1 - 0.8 ** 5) ** 25 = 0.00005 of the pairs.
BANDS, ROWS = 25, 5
#: 64-bit words of a set's parity sketch: each hash flips one of their bits.
WORDS = [f"s{k}" for k in range(8)]
_rng = np.random.default_rng(42)
TIMES = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
PLUS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
OFFSET = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, a blank one has none."""
    words = text.encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash values of a set that isn't empty; keys of different bands differ."""
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(least, (low[k : k + 4096] * TIMES + PLUS).min(1), out=least)
    return (least.astype(np.uint64).reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64) + OFFSET


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch: two sets differ in at least as many hashes as their sketches in bits."""
    odd = np.bincount((hashes >> np.uint64(23) & np.uint64(64 * len(WORDS) - 1)).astype(np.int64), minlength=64 * len(WORDS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), size and fp (SimHash) of the set, the words of its sketch and bands of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in texts(batch)]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
        words = np.ascontiguousarray(np.array([sketch(s) for s in sets]).T)
        fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), *map(pa.array, words), keys]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "fp", *WORDS, "bands"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return map_batches(docs, run, f"doc_id long, text_hash long, node long, size long, fp long, {', '.join(f'{w} long' for w in WORDS)}, bands array<long>")


def _shares(common: Column, a: Column, b: Column, near: tuple[int, int]) -> Column:
    """common / (a + b - common) >= near, in whole numbers."""
    return near[1] * common >= near[0] * (a + b - common)


def _may_share(a: str, b: str, near: tuple[int, int]) -> Column:
    """False only for sets that can't be near, by their sizes and sketches (structs ``a`` and ``b``)."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))
    return _shares(F.least(x, y), x, y, near) & ((near[0] + near[1]) * apart <= (near[1] - near[0]) * (x + y))


def _within(a: str, b: str) -> Column:
    """True in a band's bucket (even key); in a bucket of fingerprints if those of structs ``a`` and ``b`` are within BITS."""
    return (F.col("key") % 2 == 0) | (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= BITS)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, near: tuple[int, int]) -> DataFrame:
    """Those ``pairs`` (a, b: nodes) whose sets of shingles are near; only texts of nodes in pairs are read again."""
    pairs = stored(pairs)
    there = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.join(there, "node").select("node", "text_hash"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingles(t, shingle).view(np.int64) for t in texts(batch)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), sets], ["text_hash", "shingles"])

    found = docs.select(text_hash().alias("text_hash"), "text").join(few(wanted.select("text_hash").distinct()), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = stored(map_batches(found, run, "text_hash long, shingles array<long>").join(wanted, "text_hash").select("node", "shingles"))
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return cut(pairs.join(one, "a").join(two, "b").where(_shares(common, F.size("a_set"), F.size("b_set"), near)).select("a", "b"))


def near_components(docs: DataFrame, shingle: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """doc_id, text_hash and component_id (the least doc_id reachable over near pairs) of every row of ``docs``.

    Texts of the same shingles are one node. Nodes whose SimHash fingerprints differ in BITS bits or fewer are compared
    in pairs. Near pairs may differ in more (in some 10 of 64 at a similarity of 0.8); buckets of MinHash bands hold those.
    All nodes of such a bucket (a band's key), or of a crowded one of fingerprints, are first compared with its leader, the one that meets most others in all its buckets; so a large group of near copies becomes one
    component by as many comparisons as it has nodes. Then, in buckets that still hold several components,
    all pairs of nodes of different components are compared, but those that sizes and sketches rule out.
    No pair of a bucket of bands, and none within BITS, that could join two components is left out. Null and blank texts are one node. A null doc_id takes part and never becomes
    a component's id, unless no other is there.
    """
    rows = cut(prints(docs, shingle))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.min(c).alias(c) for c in ("text_hash", "size", "fp", *WORDS)]))
    others = nodes.where(near[1] * F.col("size") >= near[0] * (F.col("size") + 1))  # smaller sets are near to themselves alone
    close, crowded = wide_pairs(others.select("node", "fp"), BITS, SEGMENTS)
    close = stored(close)
    crowded = cut(crowded.select(F.xxhash64("i", "key").bitwiseOR(F.lit(1)).alias("key"), "node").distinct())
    keyed = cut(rows.select("node", F.explode("bands").alias("key")).select("node", F.col("key").bitwiseAND(F.lit(-2)).alias("key")).distinct()).unionByName(crowded)
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(met, "key"))
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    one = nodes.join(degree, "node").select("node", F.struct("degree", "node", "size", "fp", *WORDS).alias("x"))
    shared = cut(shared.select("key", "node").join(one, "node"))
    lead = shared.groupBy("key").agg(F.max("x").alias("y"))
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    led = shared.join(lead, "key").where((F.col("x.node") != F.col("y.node")) & _within("x", "y") & _may_share("x", "y", near)).select(*pair)
    first = stored(close.unionByName(led).distinct())
    edges = confirmed(first, docs, nodes, shingle, near)
    roots = connected_components(edges)
    named = cut(shared.join(roots, "node", "left").select("key", "x", F.coalesce("root", "node").alias("root")))
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main")
    open_ = cut(named.join(mixed, "key"))
    other = open_.where("root <> main").select("key", F.col("x").alias("y"), F.col("root").alias("y_root"))
    pairs = other.join(open_, "key").where((F.col("y_root") != F.col("root")) & _within("x", "y") & _may_share("x", "y", near))
    pairs = pairs.select(*pair).distinct().join(first, ["a", "b"], "left_anti")
    edges = edges.unionByName(confirmed(pairs, docs, nodes, shingle, near))
    roots = connected_components(edges)
    least = nodes.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    label = cut(nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")))
    return rows.join(label, "node").select("doc_id", "text_hash", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """One row of ``docs`` for each class of near texts, chosen by ``representatives``."""
    return representatives(docs, cut(near_components(docs, shingle, near).where("doc_id is not null")))
