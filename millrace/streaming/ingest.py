"""Change ingestion: object changes folded into a table of latest states, in batch and as a stream.

Changes (uid, namespace, name, seq, op inputs, payload columns) are keyed by a stable primary key and
merged last write wins. A stream keeps a change log with a full base now and then, both written again under
the same number on a retry, so replays don't change them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an object that an update never changes.
STICKY = ("create_time", "namespace", "name")


def stable_key(annotation: Column, uid: Column) -> Column:
    """The annotated key if set, else the uid."""
    return F.coalesce(F.nullif(annotation, F.lit("")), uid)


def operation(exists: Column, deletion_time: Column, finalizers: Column, deleting: Column, immutable: Column) -> Column:
    """What a change asks for: ignore, wait (another finalizer holds the object), retain, delete, archive or upsert."""
    return (
        F.when(~exists, "ignore")
        .when(deletion_time.isNotNull() & (finalizers > 1), "wait")
        .when(deletion_time.isNotNull(), "retain")
        .when(deleting, "delete")
        .when(immutable, "archive")
        .otherwise("upsert")
    )


def latest_changes(changes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last change of each key: one partially aggregated shuffle."""
    columns = [c for c in changes.columns if c != key]
    best = F.max_by(F.struct(*columns), F.col(seq)).alias("c_")
    return changes.groupBy(key).agg(best).select(key, "c_.*")


def upsert(snapshot: DataFrame, changes: DataFrame, key: str = "key", seq: str = "seq", sticky: tuple[str, ...] = STICKY) -> DataFrame:
    """The snapshot after the changes. The highest seq wins; sticky columns keep the snapshot's values, else the first change's."""
    keep = [c for c in sticky if c in changes.columns]
    rest = [c for c in changes.columns if c not in (key, *keep)]
    both = snapshot.select(changes.columns).withColumn("new_", F.lit(False)).unionByName(changes.withColumn("new_", F.lit(True)))
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("last_")
    first = [F.min_by(c, F.struct("new_", F.col(seq))).alias(c) for c in keep]
    return both.groupBy(key).agg(last, *first).select(key, "last_.*", *keep).select(changes.columns)


def soft_delete(snapshot: DataFrame, keys: DataFrame, at: Column, key: str = "key", must_exist: bool = False) -> DataFrame:
    """delete_time set for the given keys that are live; with ``must_exist`` a key without a live row is a LookupError."""
    wanted = keys.select(key).distinct()
    if must_exist and not wanted.join(snapshot.where(F.col("delete_time").isNull()), key, "left_anti").isEmpty():
        raise LookupError("some keys have no live row")
    gone = wanted.withColumn("gone_", F.lit(True))
    met = snapshot.join(gone, key, "left")
    hit = F.col("gone_") & F.col("delete_time").isNull()
    return met.withColumn("delete_time", F.when(hit, at).otherwise(F.col("delete_time"))).select(snapshot.columns)


def replace_side_rows(side: DataFrame, changed: DataFrame, rows: DataFrame, key: str = "obj_uid") -> DataFrame:
    """Labels or annotations: all rows of changed objects go, the new ones come."""
    return side.join(changed.select(key).distinct(), key, "left_anti").select(side.columns).unionByName(rows.select(side.columns))


def label_rows(objects: DataFrame, uid: str, labels: str) -> DataFrame:
    """(obj_uid, key, value) of a map column."""
    return objects.select(F.col(uid).alias("obj_uid"), F.explode(labels).alias("key", "value"))


#: A full snapshot is written after so many micro-batches.
COMPACT_EVERY = 16


def ingest_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "key", seq: str = "seq", compact_every: int = COMPACT_EVERY):
    """Fold a stream of changes into a change log below ``path``; starts and returns the query (available now).

    A micro-batch writes the last change of each of its keys to ``changes/batch=N``, no more than it read. Every
    ``compact_every`` batches the table so far goes to ``base/batch=N``, so a reader folds one base and fewer than
    ``compact_every`` batches of changes. Both are overwritten under the same number on a retry.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest_changes(batch, key, seq).select(batch.columns).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % compact_every == 0:
            whole = _folded(batch.sparkSession, path, number, key, seq, compact_every, compacting=True)
            whole.select(batch.columns).write.mode("overwrite").parquet(f"{path}/base/batch={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folded(spark: SparkSession, path: str, number: int, key: str, seq: str, compact_every: int, compacting: bool = False) -> DataFrame:
    done = number if compacting else number + 1  # batches whose base may be read
    base = done // compact_every * compact_every - 1
    logs = [f"{path}/base/batch={base}"] if base >= 0 else []
    logs += [f"{path}/changes/batch={n}" for n in range(base + 1, number + 1)]
    parts = [spark.read.parquet(p).withColumn("batch_", F.lit(at)) for at, p in enumerate(logs)]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    columns = [c for c in both.columns if c != "batch_"]
    keep = [c for c in STICKY if c in columns]
    rest = [c for c in columns if c not in (key, *keep)]
    last = F.max_by(F.struct(*rest), F.struct(seq, "batch_")).alias("last_")
    first = [F.min_by(c, "batch_").alias(c) for c in keep]
    return both.groupBy(key).agg(last, *first).select(key, "last_.*", *keep).select(columns)


def read_snapshot(spark: SparkSession, path: str, number: int, key: str = "key", seq: str = "seq", compact_every: int = COMPACT_EVERY) -> DataFrame | None:
    """The table after a micro-batch, folded from the last base and the changes since; None before the first.

    Key, seq and ``compact_every`` are those of the stream. The highest seq wins, of equal ones the later batch's;
    sticky columns keep their first values.
    """
    return None if number < 0 else _folded(spark, path, number, key, seq, compact_every)


def window_counts(events: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts per tumbling window and key of a stream or table; a stream closes windows by its watermark."""
    stamped = events.withColumn("at_", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at_", late)
    return stamped.groupBy(F.window("at_", window).alias("w_"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w_.start").alias("start"), *keys, "n")


def deduplicate_changes(changes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row per key and seq, the same whatever the partitioning."""
    order = Window.partitionBy(key, seq).orderBy(F.xxhash64(*changes.columns))
    return changes.withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")
