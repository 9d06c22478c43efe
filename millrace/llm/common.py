"""Shared pieces of the training-data operators: checkpoints, skew-safe joins, global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key above which a lookup join treats the key as hot.
HOT_ROWS = 50_000
#: Most hot keys that a lookup join broadcasts.
MAX_HOT_KEYS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session (tests) gets a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows of a partition of a checkpointed table that is read again and again.
COMPACT_ROWS = 20_000


def compact(df: DataFrame) -> DataFrame:
    """Checkpoint a table and deal its rows to as few partitions as they need; one needs no shuffle afterwards."""
    out = checkpoint(df)
    return out.coalesce(max(1, -(-out.count() // COMPACT_ROWS)))


def hot_keys(left: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys that more than HOT_ROWS rows of ``left`` hold; at most MAX_HOT_KEYS by the threshold itself."""
    total = left.count() if rows is None else rows
    if total < HOT_ROWS:
        return []
    least = max(HOT_ROWS, total // MAX_HOT_KEYS + 1)
    found = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= least)
    return [r[0] for r in found.where(F.col(key).isNotNull()).select(key).collect()]


def _literal(value) -> Column:
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(bytes(value) if isinstance(value, bytearray) else value)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, hot: list | None = None) -> DataFrame:
    """Equi-join of many rows per key (``left``) with one row per key (``right``).

    Rows of hot keys meet a broadcast of those keys' rows (at most MAX_HOT_KEYS of them) in place, so
    no key gathers in one task; the others meet in a shuffle. ``rows`` (of ``left``) or ``hot`` (its hot
    keys) save a pass where they are known.
    """
    hot = hot_keys(left, key, rows) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    type_ = left.schema[key].dataType
    is_hot = F.coalesce(F.col(key).isin(*[_literal(v).cast(type_) for v in hot]), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def ordered(df: DataFrame, order: list[Column | str], partitions: int) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with the partition's number as ``pid_``; checkpointed.

    Partition p's rows all sort before partition p+1's, so global running totals need only one
    total per partition beside a running total inside each.
    """
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return checkpoint(dealt.withColumn("pid_", F.spark_partition_id()))


def partition_offsets(df: DataFrame, **sums: Column) -> DataFrame:
    """Per ``pid_``, what the partitions before it add up to: one row per partition."""
    totals = df.groupBy("pid_").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("pid_", *[F.coalesce(F.sum(k).over(before), F.lit(0)).cast("long").alias(k) for k in sums])
