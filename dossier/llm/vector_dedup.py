"""Near-duplicate vectors of equal label: int8 tile products with error bounds, then full precision where a pair may link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bound_batches, connected_components, cut, few
from dossier.llm.vectors import embedded, finite_vectors, matrix, packed_groups, unpack
from dossier.sources.shared import stored

#: Vectors of a tile, and bytes of them as doubles, at most.
TILE_ROWS, TILE_BYTES = 4096, 4 << 20
#: Rows of a tile whose products are held at once, and numbers of the pairs that are computed again at once.
STRIP, AGAIN = 256, 1 << 20
#: Room for what doubles lose in a bound.
ROOM = 1e-9


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` at length 1, and which of them have a length. Powers of two bring them into range first, which is exact."""
    most = np.abs(x).max(1, initial=0)
    live = most > 0
    x = np.ldexp(x, -np.frexp(most)[1][:, None])
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(live, norm, 1)[:, None], live


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127, the step of each row, and a bound on the length of what the codes leave out."""
    step = np.maximum(np.abs(u).max(1), np.finfo(np.float64).tiny) / 127
    q = np.rint(u / step[:, None])
    error = np.sqrt(((u - q * step[:, None]) ** 2).sum(1)) * (1 + ROOM) + ROOM
    return q.astype(np.int8), step, error


class Tile:
    """Unit vectors of a tile with their codes; weight is the number of rows that each stands for."""

    def __init__(self, rows: pa.Table, dim: int):
        self.uid, self.weight = rows.column("uid").to_numpy(), rows.column("weight").to_numpy()
        self.u, _ = units(matrix(rows.column("x"), dim).astype(np.float64))
        self.q, self.step, self.error = quantised(self.u)


def linked(a: Tile, b: Tile, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``a`` with links, those rows of ``b`` whose cosine is at least ``least``; after it in the same tile.

    With unit vectors u = s q + e, the cosine differs from the code product s s' (q q') by at most |e'| (1 + |e|) + |e|. Code
    products are exact (whole numbers below 2^24 in floats, else in doubles). Pairs below ``least`` by more than that are done.
    """
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b.q.astype(kind).T
    chunk = max(1, AGAIN // a.q.shape[1])
    for at in range(0, len(a.uid), STRIP):
        rows = slice(at, at + STRIP)
        product = (a.q[rows].astype(kind) @ right).astype(np.float64)
        slack = b.error * (1 + a.error[rows, None]) + a.error[rows, None] + ROOM
        maybe = product * (a.step[rows, None] * b.step) + slack >= least
        if a is b:
            maybe &= np.arange(len(b.uid)) > np.arange(at, at + len(maybe))[:, None]
        i, j = np.nonzero(maybe)
        near = np.empty(len(i), bool)
        for k in range(0, len(i), chunk):
            near[k : k + chunk] = np.einsum("ij,ij->i", a.u[at + i[k : k + chunk]], b.u[j[k : k + chunk]]) >= least
        i, j = i[near], j[near]
        if not len(i):
            continue
        heads, first = np.unique(i, return_index=True)
        for row, found in zip(heads.tolist(), np.split(j, first[1:]), strict=True):
            yield at + row, found


def tile_links(a: Tile, b: Tile, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of ``a`` and of ``b``, counted by weight, and edges that hold together what the tiles' links do: fewer than their rows."""
    same = a is b
    shift = 0 if same else len(a.uid)
    uid = a.uid if same else np.concatenate([a.uid, b.uid])
    root = np.arange(len(uid))
    n_a, n_b = np.zeros(len(a.uid), np.int64), np.zeros(len(b.uid), np.int64)
    edges = []
    for row, found in linked(a, b, least):
        n_a[row] += b.weight[found].sum()
        n_b[found] += a.weight[row]
        tops = np.unique(np.append(root[found + shift], root[row]))
        if len(tops) > 1:
            edges += [(int(uid[tops[0]]), int(uid[t])) for t in tops[1:]]
            root[np.isin(root, tops[1:])] = tops[0]
    return n_a, n_b, edges


def tiles_met(nodes: DataFrame, least: float) -> DataFrame:
    """(uid, n, other): links of a vector found in a pair of tiles (other is null), or an edge to another vector (n is null).

    ``nodes``: uid, label, dim, x, weight. Vectors of a label and length are dealt to tiles of bounded size; each pair of tiles is one
    task's work, found by a join of the tiles on the pair, and gives no more rows than its tiles have.
    """
    per = lambda: F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_BYTES) / (8 * F.greatest("dim", F.lit(1))))))
    counts = few(nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / per()).cast("int").alias("n_tiles")))
    dealt = nodes.join(counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("n_tiles")).cast("int"))
    keys = ["label", "dim", "n_tiles", "tile"]
    tiles = stored(packed_groups(dealt.select(*keys, "uid", "x", "weight"), keys, "label long, dim int, n_tiles int, tile int"))
    side = lambda i, j, first, last: tiles.select("label", "dim", F.col("tile").alias(i), F.explode(F.sequence(first, last)).alias(j), F.col("payload").alias(f"of_{i}"))
    left = side("a", "b", F.col("tile"), F.col("n_tiles") - 1)
    right = side("b", "a", F.lit(0), F.col("tile"))
    pairs = left.join(right, ["label", "dim", "a", "b"]).select("dim", (F.col("a") == F.col("b")).alias("same"), "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, same, of_a, of_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                a = Tile(unpack(of_a.as_py()), dim)
                b = a if same else Tile(unpack(of_b.as_py()), dim)
                n_a, n_b, edges = tile_links(a, b, least)
                n = n_a + n_b if same else np.concatenate([n_a, n_b])
                uid = a.uid if same else np.concatenate([a.uid, b.uid])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(n[some]), pa.nulls(len(some), pa.int64())], ["uid", "n", "other"])
                ends = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.nulls(len(ends), pa.int64()), pa.array(ends[:, 1])], ["uid", "n", "other"])

    return pairs.mapInArrow(run, "uid long, n long, other long")


def vector_key() -> list[Column]:
    """128 bits that name an embedding."""
    return [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, label, embedding).

    Two rows of one label link if their vectors, of one length, have a cosine of at least ``least`` in double precision. Null
    labels, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing. n_links counts the other
    rows linked directly; component_id is the least vec_id reached over links, the row's own included; kept marks the rows that
    carry it. Rows that repeat a vec_id are all rows. A null vec_id takes part and names a component only if no other is
    there, in which case such rows are kept. An empty table gives an empty result.

    Equal vectors of a label are one node that counts for all its rows, so copies give no pairs; between different vectors tiles
    of a label meet in pairs, see ``tiles_met``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = embedded(vectors).withColumns({"k1": vector_key()[0], "k2": vector_key()[1]})
    sorts = rows.where("label is not null and embedding is not null").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_vectors(batch.column(batch.schema.get_field_index("embedding"))):
                at = at[units(x)[1]]
                if len(at):
                    yield batch.take(pa.array(at)).append_column("dim", pa.array(np.full(len(at), x.shape[1], np.int32)))

    kind = vectors.schema["embedding"].dataType.simpleString()
    sorts = sorts.select("label", "weight", "first_id", *vector_key(), "embedding")
    nodes = sorts.mapInArrow(live, f"label long, weight long, first_id long, k1 long, k2 long, embedding {kind}, dim int").withColumnRenamed("embedding", "x")
    nodes = stored(nodes.withColumn("uid", F.monotonically_increasing_id()))
    met = stored(tiles_met(nodes.select("uid", "label", "dim", "x", "weight"), least))
    links = met.where("other is null").groupBy("uid").agg(F.sum("n").alias("n"))
    roots = connected_components(met.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("uid"), "root")
    named = nodes.select("uid", "label", "k1", "k2", "weight", "first_id").join(links, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = cut(named.where("n is not null or weight > 1"))
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = few(named.join(least_id, "root").select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "label", "k1", "k2").join(found, ["label", "k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
