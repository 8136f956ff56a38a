"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so later jobs survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths of the tables that ``stored`` has written in this process.
_MADE: list[str] = []


def stored(df: DataFrame, **options: str) -> DataFrame:
    """As ``cut``, as a Parquet table: the planner then knows its size when it picks a join."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to all executors at most.
FEW = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A stored table with the hint to send it to all executors, if it has few rows; else as it is."""
    return F.broadcast(table) if table.count() <= FEW else table


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Of each query that is begun inside, Spark deletes the shuffle files as soon as it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes from fewer files than there are cores, of which most would idle; larger tables are read where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def removed(table: DataFrame) -> None:
    """Deletes what ``stored`` has written."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


@contextmanager
def only_last_table(spark: SparkSession) -> Iterator[None]:
    """Of the tables stored inside, the last one stays; the others are deleted at the end."""
    begun = len(_MADE)
    yield
    for path in _MADE[begun:-1]:
        remove(spark, path)
    del _MADE[begun:-1]
