"""WARC archives: write, normalise monolithic gzip files to one member per record, index, read back.

Records are written by Spark's text writer with the gzip codec: one file per task, the whole file one
gzip stream, ``CR LF CR LF`` behind every record. Such a monolithic archive can't be read from the middle. The
normaliser inflates each file once, as a stream, writes every record as a gzip member of its own and
a sidecar index (record id, offset, length) beside it. Readers then seek to single records.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a ``response``
record, the others are ``revisit`` records that carry the payload's digest and size but not the payload.
Null html is an empty payload and null urls an empty target; pages with a null page_id are written as
responses and never referred to; repeated rows with equal payloads become one response and revisits of it.
An empty table gives an empty archive. Extra columns of any name are left out; payloads of any length stream
through in pieces of bounded size, one record at a time in memory. Archives and indexes lie in the folder given,
which all executors must share.

Every attempt of a task writes files of its own name and nothing is renamed. The index rows that come back name
the archives of the finished attempts; the manifest written from them is the commit, and readers take no
other file. What lost or doubled attempts left behind is deleted after the commit and could not be read before.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, lookup_join

#: Payload bytes from which equal payloads are written once.
LEAST_REVISIT = 100
#: Bytes that are read from an archive at a time.
READ = 1 << 20
#: Bytes of neighbouring records that one read fetches at most.
SPAN = 1 << 22

#: Inflated bytes that are held at a time besides the record they belong to.
PIECE = 1 << 20

INDEX = "path string, record_id string, offset long, length long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else "file://" + path)


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, type, refers_to and the record's text (header block and payload) of each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"),
    )
    ids = page.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    met = lookup_join(page, ids.where("n > 1").select("digest", "first"), "digest", "left")
    # repeated rows of the first page: one of them is the response
    twice = ids.where("n > 1").join(page.select("digest", F.col("page_id").alias("first")), ["digest", "first"]).groupBy("digest").count().where("count > 1")
    if twice.isEmpty():
        later = F.col("page_id") != F.col("first")
    else:
        same = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        met = met.withColumn("same", F.when(F.col("page_id") == F.col("first"), same))
        later = (F.col("page_id") != F.col("first")) | (F.col("same") > 1)
    revisit = F.coalesce(later, F.lit(False))
    crlf = F.lit("\r\n")
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html")))
    target = F.regexp_replace("url", "[\r\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), crlf,
        F.lit("WARC-Record-ID: "), F.coalesce(record_id(F.col("page_id")), F.lit("<urn:x-page:>")), crlf,
        F.lit("WARC-Target-URI: "), target, crlf,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), crlf,
        F.lit("X-Payload-Length: "), F.col("bytes").cast("string"), crlf,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first")), crlf)).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(F.col("block")).cast("string"), crlf, crlf,
    )
    return met.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_monolithic(rows: DataFrame, path: str) -> None:
    """One gzip stream per task, through Spark's own writer and committer."""
    rows.write.mode("error").option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record with its end mark) from a stream of inflated bytes."""
    held, ended = bytearray(), False
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal ended
        got = next(chunks, None)
        if got is None:
            ended = True
            return False
        held.extend(got)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        headers = parse_headers(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield headers, bytes(held[:size])
        del held[:size]


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, in pieces of PIECE bytes at most."""
    box, fresh = zlib.decompressobj(31), True
    while raw := stream.read(READ):
        while raw:
            piece = box.decompress(raw, PIECE)
            fresh = False
            if piece:
                yield piece
            raw = box.unconsumed_tail
            if box.eof:
                raw, box, fresh = box.unused_data, zlib.decompressobj(31), True
    while not fresh and not box.eof:
        if not (piece := box.decompress(box.unconsumed_tail, PIECE)):
            raise ValueError("the archive ends inside a gzip member")
        yield piece


def _normalise(target: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = source.rsplit("/", 1)[1].removesuffix(".txt.gz")
                done = f"{target}/{name}.{uuid.uuid4().hex}.warc.gz"
                fs, inner = _open(source)
                out_fs, out = _open(done)
                out_fs.create_dir(out.rsplit("/", 1)[0], recursive=True)
                ids, offsets, lengths, at = [], [], [], 0
                with (
                    fs.open_input_stream(inner, compression=None) as stream,
                    out_fs.open_output_stream(out, compression=None) as sink,
                    out_fs.open_output_stream(f"{out}.idx", compression=None) as index,
                ):
                    for headers, record in split_records(_inflated(stream)):
                        box = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = box.compress(record) + box.flush()
                        sink.write(member)
                        index.write((json.dumps({"record_id": headers["warc-record-id"], "offset": at, "length": len(member)}) + "\n").encode())
                        ids.append(headers["warc-record-id"])
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                columns = [pa.array([done] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "record_id", "offset", "length"])

    return run


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the gzip archives in a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")


def _manifest(target: str) -> str:
    return f"{target}/_manifest"


def normalise(spark: SparkSession, monolithic: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite each archive below ``monolithic`` record by record; the index rows of all records.

    Beside each ``.warc.gz`` lies its sidecar ``.warc.gz.idx``, one JSON object per record. The rows are
    checkpointed, so the rewriting runs once; the manifest of their archives commits it.
    """
    files = archives(spark, monolithic)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = checkpoint(files.repartition(parts, "path").mapInArrow(_normalise(target, level), INDEX))
    rows.select("path").distinct().write.mode("overwrite").parquet(_manifest(target))
    _sweep(spark, target)
    return rows


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+?)(?:\\.idx)?$", 1)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = _open(path)
            if fs.get_file_info(inner).type == pafs.FileType.File:
                fs.delete_file(inner)
        yield batch


def _sweep(spark: SparkSession, target: str) -> None:
    """Delete the files of attempts that the manifest does not name."""
    held = spark.read.parquet(_manifest(target)).select(_name(F.col("path")).alias("name"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz*").load(target).select("path")
    left = found.withColumn("name", _name(F.col("path"))).join(held, "name", "left_anti").select("path")
    left.mapInArrow(_delete, "path string").write.format("noop").mode("overwrite").save()


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar index files of the committed archives of a folder as a table."""
    rows = spark.read.schema("record_id string, offset long, length long").option("pathGlobFilter", "*.idx").json(target)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_path"), "\\.idx$", "").alias("path"), "record_id", "offset", "length")
    held = spark.read.parquet(_manifest(target)).select(_name(F.col("path")).alias("name"))
    return rows.withColumn("name", _name(F.col("path"))).join(held, "name", "left_semi").drop("name")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("record_id", "record_type", "refers_to", "target_uri", "digest", "payload_bytes", "payload")}
        rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: (r[0], r[2]))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end][0] == rows[at][0] and rows[end][2] + rows[end][3] - rows[at][2] <= SPAN:
                end += 1
            fs, inner = _open(rows[at][0])
            with fs.open_input_file(inner) as stream:
                stream.seek(rows[at][2])
                raw = stream.read(rows[end - 1][2] + rows[end - 1][3] - rows[at][2])
            for _, record_id, offset, length in rows[at:end]:
                record = zlib.decompress(raw[offset - rows[at][2] : offset - rows[at][2] + length], 31)
                head, _, rest = record.partition(b"\r\n\r\n")
                headers = parse_headers(head)
                if headers["warc-record-id"] != record_id:
                    raise ValueError(f"the index gives {record_id}, the archive {headers['warc-record-id']}")
                block = rest[: int(headers["content-length"])]
                payload = block.partition(b"\r\n\r\n")[2]
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {record_id} does not have its digest")
                for k, v in zip(out, (record_id, headers["warc-type"], headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, int(headers["x-payload-length"]), payload if headers["warc-type"] == "response" else None), strict=True):
                    out[k].append(v)
            at = end
            if sum(len(p) for p in out["payload"] if p) > SPAN:
                yield _batch(out)
                out = {k: [] for k in out}
        yield _batch(out)


def _batch(out: dict) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))


def read_records(index: DataFrame) -> DataFrame:
    """The records an index points to, each fetched by its offset; digests of responses are checked."""
    return index.select("path", "record_id", "offset", "length").mapInArrow(
        _fetch, "record_id string, record_type string, refers_to string, target_uri string, digest string, payload_bytes long, payload binary"
    )
