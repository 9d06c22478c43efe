"""Places in a global order, and checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint: what is computed from them no longer depends on a task that ran twice."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column | str], output: str) -> DataFrame:
    """Rows with their place in an order, from 0; keys of any type that sorts.

    Rows are dealt by ranges of all keys and sorted inside each range; a place is the rows of the ranges before, one
    number per range, and the running count inside. No task holds all rows; ties of all keys share a range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpointed(dealt.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("part", before.alias("before")))  # one row per range
    # inside a partition the increasing id counts from the partition's number times 2**33
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "part").select("row.*", place.alias(output))
