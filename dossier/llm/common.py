"""Helpers shared by the training-data operators: Arrow batch maps, shared storage, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dossier.operators.graph import connected_components  # noqa: F401
from dossier.sources.shared import cut, shared_folder, stored  # noqa: F401

#: Rows and bytes of one Arrow batch handed to Python, which bound what a worker holds.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Keys (of two whole numbers at most) that are sent to all executors at most.
MOST_KEYS = 1_000_000


def few(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """A table of keys, stored, and marked for broadcast if it has ``most`` rows at most; else the planner shuffles for it."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= most else df


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's folder, for a caller that deletes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what a worker may hold; Spark reads these settings when a plan runs, so they stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < size_of(spark.conf.get(key, None)) <= most:
            spark.conf.set(key, str(most))


def size_of(setting: str | None) -> int:
    """A size setting in bytes or rows; 0 if unset."""
    number = (setting or "0").strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct named row, so that their names can't clash with those of an operator."""
    return F.struct(*map(column, df.columns)).alias("row")


def with_row(df: DataFrame, ddl: str) -> StructType:
    """row (the columns of ``df``) and the fields of ``ddl``."""
    return StructType([StructField("row", df.schema, False), *StructType.fromDDL(ddl).fields])


def replaced(df: DataFrame, text: Column, changed: Column) -> list[Column]:
    """The columns of ``df`` from ``row``, with ``text`` in place of its text; n_chars, where it is there, follows."""
    cols = []
    for c in df.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length(text)).otherwise(F.col("row.n_chars")).cast(df.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"row.{quoted(c)}"))
    return cols


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


_WORKER: dict = {}


def once(key: tuple, make: Callable):
    """``make()``, kept in this worker process."""
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
