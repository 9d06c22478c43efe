"""Exact deduplication by a stateful stream.

A file stream of documents keeps, per SHA-256 digest, disk-backed (RocksDB) state that never expires:
the stable identifier of the row that stays (the largest doc_id), the content locator (file and row
index) of that row, and the number of rows. Rows are pre-aggregated in each task before they reach the
state. Every micro-batch appends the changed entries to a log; the last entry of a digest is its state.

On a hit (a digest with more than one row) the full bytes decide: each such row's text is compared
with the content at the entry's locator. Rows whose bytes differ are grouped by their full text
instead, so a digest collision can't merge different texts.

Texts that occur once need no comparison: a bitmap of the hit digests (a Bloom filter of one hash, as
digests are uniform; at most MAX_BITS bits whatever the input) leaves them out before texts are shuffled.

Null text counts as empty; texts of any length are hashed and compared whole; extra columns of any name are not read; an
empty table gives no rows; rows with a null doc_id are counted but stay only if no other row of the
group has one (then ``keep_id`` is null); repeated rows are one group, and every row with the kept
identifier is ``kept``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, lookup_join, scratch

#: Settings of the state store while the stream runs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk space is set aside for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bits of the bitmap of hit digests for each hit, and at most; 2**28 bits are 32 MB.
BITS_PER_HIT = 32
MAX_BITS = 1 << 28
#: Micro-batches that an input of many files is taken in.
BATCHES = 4
#: Rows of one digest that one copy of the kept text serves.
SHARE = 2_000


def _fingerprints(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def _keeper():
    """The largest doc_id with its locator; of rows with that doc_id, one by file and row."""
    return F.max(F.struct("doc_id", "file", "row")).alias("keep")


def _pattern(path: str) -> str:
    """A glob that matches the path itself; as a pattern, a single file is taken as well as a folder."""
    path = path.rstrip("/")
    plain = "".join("\\" + c if c in "\\*?[]{}," else c for c in path[:-1])
    return f"{plain}[{path[-1]}]" if path[-1].isalnum() else f"{plain}\\{path[-1]}"


def _batch_bytes(spark: SparkSession, path: str) -> int:
    """A share of the bytes of all files, so that the stream runs in BATCHES micro-batches at any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_pattern(path)).select("length")
    return max(1, -(-(files.agg(F.sum("length")).first()[0] or 1) // BATCHES))


def run_stream(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Stream the Parquet files at ``path`` through the keyed state; digest, keep, group_size as it ends."""
    schema = spark.read.parquet(_pattern(path)).schema
    log, state = scratch(spark, "dedup-log"), scratch(spark, "dedup-state")
    docs = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(_pattern(path))
    counted = _fingerprints(docs).groupBy("digest").agg(_keeper(), F.count(F.lit(1)).alias("group_size"))

    def append(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = counted.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    entries = spark.read.schema("digest binary, keep struct<doc_id:bigint,file:string,row:bigint>, group_size bigint, batch int").parquet(log)
    last = entries.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("e"))
    return last.select("digest", "e.keep", "e.group_size")


def exact_duplicates(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``max_bytes`` bounds the files of a micro-batch; left out, it is a BATCHES-th of all bytes.
    """
    path = path.rstrip("/")
    entries = checkpoint(run_stream(spark, path, _batch_bytes(spark, path) if max_bytes is None else max_bytes))
    docs = _fingerprints(spark.read.parquet(_pattern(path)))
    rows = checkpoint(docs.select("doc_id", "digest", "file", "row"))
    met = lookup_join(rows, entries, "digest")
    differ = checkpoint(_differing(docs, entries.where("group_size > 1")))
    if not differ.isEmpty():
        met = _regroup(rows, docs, entries, differ)
    return met.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep.doc_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _differing(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Locators of rows whose full bytes differ from the content at their digest's locator.

    The kept text goes, in as many copies as its group needs, to the rows it is compared with.
    """
    hits = hits.withColumn("copies", F.ceil(F.col("group_size") / SHARE).cast("int"))
    texts = checkpoint(lookup_join(_maybe_hit(docs, hits), hits, "digest"))
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    salt = F.pmod(F.xxhash64("file", "row"), F.col("copies")).cast("int")
    seen = texts.where(~is_kept).select("digest", "text", "file", "row", salt.alias("salt"))
    kept = texts.where(is_kept).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return seen.join(kept, ["digest", "salt"]).where("text != kept_text").select("digest", "file", "row")


def _maybe_hit(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest the bitmap of hits holds: all rows of hits, and few others."""
    n = hits.count()
    bits = min(MAX_BITS, 1 << max(15, (BITS_PER_HIT * n).bit_length()))
    # a bit per value of the digest's first bytes; bitmaps of 32768 bits each are one row
    place = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long") % bits
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = hits.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("map"))
    met = docs.withColumns({"bucket": bucket, "at": at}).join(F.broadcast(maps), "bucket")  # MAX_BITS bits at most
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("long")) > 0).drop("bucket", "at", "map")


def _regroup(rows: DataFrame, docs: DataFrame, entries: DataFrame, differ: DataFrame) -> DataFrame:
    """Entries by full text for the digests whose rows differ; the others as they are."""
    mixed = differ.select("digest").distinct()
    whole = lookup_join(docs, mixed, "digest")
    by_text = whole.groupBy("digest", "text").agg(_keeper(), F.count(F.lit(1)).alias("group_size"))
    again = whole.join(by_text, ["digest", "text"]).select("digest", "doc_id", "file", "row", "keep", "group_size")
    rest = lookup_join(rows, entries.join(mixed, "digest", "left_anti"), "digest")
    return rest.unionByName(again)
