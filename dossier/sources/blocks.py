"""Rows packed into blocks of bounded size, each one binary value, so that blocks can be joined."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def packed(df: DataFrame, block_bytes: int) -> DataFrame:
    """payload: the rows of each task in blocks of some ``block_bytes``, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            step = max(1, batch.num_rows * block_bytes // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                if sum(b.nbytes for b in held) >= block_bytes:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return df.mapInArrow(run, "payload binary")


def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()
