"""Row numbers of very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.sources.shared import cut


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, among those of its ``keys`` (none: of all) in ``order``, as a long.

    Rows are dealt to tasks by ranges of keys and order, so many tasks share a large group; each counts its rows of a key, and the
    sums of the counts before a task, a row for each task and key, place them. ``order`` decides between any two rows.
    """
    key = keys or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
    dealt = cut(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("_task", *key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ["_task", *key]]
    found = dealt.alias("d").join(counts.alias("c"), same).select("d.*", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
    return found.drop("_task", "_at", "_all")
