"""Contiguous byte-balanced shards from global prefix sums.

Documents are put in one global order: SHA-256 of the text, then doc_id. Equal texts are so next to each
other and the order is a fair shuffle. The rows are range-partitioned and sorted once; one total
per partition gives each partition its offset, and the running total inside it completes the global
prefix sum. A document goes to the shard in whose equal share of all bytes its middle byte falls, so
every cut is within half a document of its target and shards are contiguous in the order.

The law is ``bytes``: a group of equal texts is contiguous and lies in one shard unless a cut falls into
it, which parts it over neighbouring shards; sizes of shards differ by less than two documents, however large a group is.

A document's size is its UTF-8 bytes plus 8 (null text has no bytes and the checksum of nothing);
repeated rows and null ids are placed like others, a document larger than a shard's share takes its shard
alone and may leave neighbours empty, extra columns of any name are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, ordered, partition_offsets


def _place(shards: int, total: int):
    """Shard of each row of one sorted partition, and the row's number among the partition's rows of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, current, inside = 0, -1, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = np.array(batch.column("size"), np.int64)
            ends = seen + np.cumsum(size)
            starts = ends - size + int(batch.column("before")[0].as_py())
            seen = int(ends[-1])
            # twice the middle byte times the shards over twice all bytes; Python integers can't overflow
            exact = total < 2**62 // (2 * shards)
            middle = 2 * starts + size
            at = middle * shards // (2 * total) if exact else np.array([int(m) * shards // (2 * total) for m in middle], np.int64)
            shard = np.minimum(at, shards - 1).astype(np.int32)
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            within = np.arange(len(shard)) - np.repeat(first, np.diff(np.append(first, len(shard))))
            if shard[0] == current:
                within[shard == current] += inside
            inside = int(within[-1]) + 1
            current = int(shard[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("crc"), batch.column("pid_"), pa.array(shard), pa.array(within.astype(np.int64))],
                names=["doc_id", "size", "crc", "pid_", "shard", "within"],
            )

    return run


def byte_balanced(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, crc (of the UTF-8 text, unsigned), shard and slot (place in the shard, from 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ordered(keyed, ["digest", "doc_id"], parts).drop("digest")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    before = F.broadcast(partition_offsets(rows, before=F.col("size")))  # one row per partition
    placed = rows.join(before, "pid_").mapInArrow(
        _place(shards, int(total)), "doc_id long, size long, crc long, pid_ int, shard int, within long"
    )
    placed = checkpoint(placed)
    counts = placed.groupBy("shard", "pid_").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "pid_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    out = placed.join(F.broadcast(starts), ["shard", "pid_"])  # partitions plus shards rows at most
    return out.select("doc_id", "size", "crc", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
