"""Hard negatives: for each anchor all rows in order of their score, and those just below each positive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import bound_batches, stored
from dossier.llm.vectors import block_rows, embedded, finite_vectors, floored, lists, matrix, pack, packed_groups, total_bytes, unpack

#: Anchors of a block, and bytes of anchor blocks that are sent to all executors at most; with more, rows are shuffled to them.
ANCHORS, MOST_BYTES = 1024, 64 << 20
LONG = (1 << 63) - 1
ROW_BLOCKS = "dim int, payload binary"


def codes(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the length, ids, labels and whole-number vectors of the rows that take part."""
    ids, labels = batch.column(0), batch.column(1)
    named = np.logical_and(ids.is_valid().to_numpy(False), labels.is_valid().to_numpy(False))
    ids, labels = ids.fill_null(0).to_numpy(False), labels.fill_null(0).to_numpy(False)
    for rows, x in finite_vectors(batch.column(2)):
        keep = named[rows]
        if keep.any():
            yield x.shape[1], ids[rows[keep]], labels[rows[keep]], floored(x[keep], scale, LONG)


def table_of(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> pa.Table:
    narrow = np.abs(x).max(initial=0) < 1 << 31
    return pa.table({"vec_id": ids, "label": labels, "code": lists(x.astype(np.int32) if narrow else x)})


def row_blocks(rows: DataFrame, scale: int) -> DataFrame:
    """dim and payload: the rows of each task in blocks, each in order of vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, labels, x = map(np.concatenate, zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "payload": pa.array([pack(table_of(ids[order], labels[order], x[order]))], pa.binary())})

        for batch in batches:
            for dim, *found in codes(batch, scale):
                held.setdefault(dim, []).append(found)
                if sum(len(f[0]) for f in held[dim]) >= block_rows(dim):
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, ROW_BLOCKS)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can pass 2^53, else in whole numbers of any size, held at 64 bits."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    exact = anchors.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def score_order(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of a row of scores, the highest first, ties by the smaller id."""
    return np.lexsort((ids, -row))


def met(rows: DataFrame, anchors: DataFrame, n_blocks: int, schema: str, fn: Callable[[pa.Table, pa.Table, int], pa.Table]) -> DataFrame:
    """``fn`` of each block of ``rows`` and each block of ``anchors`` (ab, dim, payload) of vectors as long."""
    few = total_bytes(anchors) <= MOST_BYTES
    each = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = each.join((F.broadcast if few else lambda x: x)(anchors.withColumnRenamed("payload", "anchors")), ["ab", "dim"]).select("dim", "payload", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, payload, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield from fn(unpack(payload.as_py()), unpack(block.as_py()), dim).combine_chunks().to_batches()

    bound_batches(rows.sparkSession)
    return pairs.mapInArrow(run, schema)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key and their rank: by score, then by the smaller id. Each task keeps its own first ``k`` before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def hard_negatives(vectors: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors``: vec_id, label, embedding. A row's vector is floor(scale * component); its score is its inner product with
    the anchor, and scores are ordered from the highest, ties by the smaller vec_id. Anchors are the rows whose vec_id
    ``every`` divides. For each of an anchor's first ``positives`` rows of its own label come the first ``negatives`` rows of
    other labels whose score is at most the positive's and at least ``least`` (a fraction) of it.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; vectors meet those of
    their own length only. Other rows of the anchor's own vec_id are not its positives; rows that repeat count as often as they
    stand there, and each row of a repeated anchor gives its own result. Whole numbers are held at 64 bits either way. An anchor
    without positives, or a positive without rows in its window, gives nothing; an empty table gives an empty result.

    Anchors meet all rows block by block. In each block all scores of an anchor are sorted; only a block's first
    ``positives`` and, once those are known, for each of them its first ``negatives`` go on, so what is shuffled grows with anchors
    times blocks and no anchor's scores are held in one place.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = embedded(vectors)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, labels, x in codes(batch, scale):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), dim, np.int32)), lists(x)], ["vec_id", "label", "dim", "code"])

    anchors = v.where(F.col("vec_id") % every == 0).mapInArrow(coded, "vec_id long, label long, dim int, code array<long>")
    anchors = stored(anchors.withColumn("uid", F.monotonically_increasing_id()))
    n_blocks = -(-anchors.count() // ANCHORS) or 1
    dealt = anchors.withColumn("ab", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int"))
    rows = row_blocks(v, scale)

    def best(block: pa.Table, mine: pa.Table, dim: int) -> pa.Table:
        ids, labels = (block.column(c).to_numpy() for c in ("vec_id", "label"))
        uids, own, label = (mine.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        s = scores(matrix(mine.column("code"), dim), matrix(block.column("code"), dim))
        out: list[tuple] = []
        for a in range(len(uids)):
            same = np.flatnonzero((labels == label[a]) & (ids != own[a]))
            top = same[score_order(s[a, same], ids[same])[:positives]]
            out.append((np.full(len(top), uids[a]), s[a, top], ids[top]))
        uid, score, vec_id = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"uid": uid, "score": score, "vec_id": vec_id})

    near = first_of(met(rows, packed_groups(dealt, ["ab", "dim"], "ab int, dim int"), n_blocks, "uid long, score long, vec_id long", best), ["uid"], positives)
    wanted = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("near"))
    wanted = wanted.select("uid", F.col("near.score").alias("near_scores"), F.col("near.vec_id").alias("near_ids"))
    dealt = stored(dealt.join(wanted, "uid"))
    names = "uid long, place int, anchor_id long, positive_id long, positive_score long, score long, vec_id long"

    def below(block: pa.Table, mine: pa.Table, dim: int) -> pa.Table:
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        label = mine.column("label").to_numpy()
        s = scores(matrix(mine.column("code"), dim), matrix(block.column("code"), dim))
        found: list[tuple] = []
        for a, (uid, own, near_scores, near_ids) in enumerate(zip(*(mine.column(c).to_pylist() for c in ("uid", "vec_id", "near_scores", "near_ids")), strict=True)):
            other = np.flatnonzero(labels != label[a])
            order = other[score_order(s[a, other], ids[other])]
            falling = -s[a, order]
            for place, (limit, positive) in enumerate(zip(near_scores, near_ids, strict=True)):
                lower = -(-limit * least[0] // least[1])
                at = np.searchsorted(falling, -limit, "left")
                read = order[at : at + negatives]
                read = read[s[a, read] >= lower]
                found += [(uid, place, own, positive, limit, n, i) for n, i in zip(s[a, read].tolist(), ids[read].tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in names.split(", ")])

    blocks = packed_groups(dealt, ["ab", "dim"], "ab int, dim int")
    found = first_of(met(rows, blocks, n_blocks, names, below), ["uid", "place"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
