"""Sinks: Parquet, tables, CSV, JSON, memory, and one table to several of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

MODES = ("overwrite", "append", "ignore", "error")
#: Most rows of one Parquet file.
ROWS_PER_FILE = 2_000_000


def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    return mode


@dataclass
class ParquetSink:
    path: str
    mode: str = "error"
    rows_per_file: int = ROWS_PER_FILE
    partition_by: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> None:
        out = df.write.mode(_mode(self.mode)).option("compression", "zstd").option("maxRecordsPerFile", self.rows_per_file)
        out.partitionBy(*self.partition_by).parquet(self.path)


@dataclass
class TableSink:
    table: str
    mode: str = "overwrite"
    partition_by: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> None:
        df.write.mode(_mode(self.mode)).partitionBy(*self.partition_by).saveAsTable(self.table)


@dataclass
class FileSink:
    """CSV, Parquet or JSON lines below a path or object-store prefix; ``partitions`` sets the number of files."""

    path: str
    format: str = "parquet"
    mode: str = "error"
    partitions: int | None = 1

    def __post_init__(self) -> None:
        if self.format not in ("csv", "parquet", "json"):
            raise ValueError(f"unknown format {self.format!r}")
        if not self.path:
            raise ValueError("the path is empty")
        scheme, mark, rest = self.path.partition("://")
        bucket, _, prefix = rest.partition("/")
        if mark and scheme not in ("file", "hdfs", "viewfs") and (not bucket or prefix.startswith("/")):
            raise ValueError("an object store's path needs a bucket, and its prefix begins without a slash")
        self.path = self.path.rstrip("/")

    def write(self, df: DataFrame) -> None:
        df = df if self.partitions is None else df.repartition(self.partitions)
        df.write.mode(_mode(self.mode)).option("header", "true").format(self.format).save(self.path)


@dataclass
class MemorySink:
    """Small results as rows on the driver, at most ``limit``."""

    limit: int = 100_000
    records: list = field(default_factory=list)

    def write(self, df: DataFrame) -> None:
        rows = df.limit(self.limit + 1).collect()
        if len(rows) > self.limit:
            raise ValueError(f"more than {self.limit} rows")
        self.records = [r.asDict(recursive=True) for r in rows]


@dataclass
class ReportSink:
    """Evaluation reports, one JSON document each, as ``<path>/<name>`` on any file system Spark can write."""

    path: str
    mode: str = "error"

    def write(self, spark: SparkSession, report: dict, extra: dict | None = None) -> str:
        """Write a small report; ``extra`` wins over its fields. Returns where it went."""
        name = (report.get("metadata") or {}).get("name")
        if not name:
            raise ValueError("the report has no metadata.name")
        document = json.dumps({**report, **(extra or {})})
        target = f"{self.path.rstrip('/')}/{name}"
        spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode(_mode(self.mode)).text(target)
        return target


@dataclass
class CallReportSink:
    """Reports handed to a function, such as a client of a service; gives back what it returns."""

    send: Callable[[dict], object]

    def write(self, spark: SparkSession, report: dict, extra: dict | None = None) -> object:
        return self.send({**report, **(extra or {})})


def push(df: DataFrame, sinks: list) -> int:
    """Write one table to several sinks in order; the plan runs once. Returns its rows."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = held.count()
        for sink in sinks:
            sink.write(held)
        return rows
    finally:
        held.unpersist()


def write_result(path: str, value: object) -> None:
    """A task's result as JSON on the driver."""
    with open(path, "w") as f:
        json.dump(value, f)
