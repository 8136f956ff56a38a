"""Vectors of Arrow batches as numpy arrays, and groups of rows packed as one value, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bound_batches, column

#: Bytes of the vectors of one packed block, as doubles; and its rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192


def block_rows(dim: int) -> int:
    """Rows of a block of vectors of ``dim`` components."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))


def finite_vectors(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length, the rows whose vector is there and holds finite numbers only, and these vectors as doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        sound = np.isfinite(x).all(1)
        yield rows[sound], x[sound]


def floored(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as 64-bit whole numbers, held at ``most`` either way; a product beyond doubles is held there too."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    over = np.abs(y) >= most
    out = np.where(over, 0, y).astype(np.int64)
    out[over] = np.where(y[over] > 0, most, -most)
    return out


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def matrix(values: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as a matrix."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def packed_groups(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """``schema`` names and types the keys: a row for each of their values, its rows as payload. The caller bounds the groups."""

    def run(table: pa.Table) -> pa.Table:
        head = table.select(keys).slice(0, 1)
        return head.append_column("payload", pa.array([pack(table.drop_columns(keys))], pa.binary()))

    bound_batches(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, f"{schema}, payload binary")


def embedded(df: DataFrame) -> DataFrame:
    """vec_id (long), label (long) and embedding of ``df``, whatever other columns it has."""
    return df.select(column("vec_id").cast("long").alias("vec_id"), column("label").cast("long").alias("label"), column("embedding").alias("embedding"))


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
