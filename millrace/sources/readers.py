"""Readers: Parquet (with empty files left out), CSV, TSV, item tables, raw files, in-memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_parquet_nonempty(spark: SparkSession, path: str, pattern: str = "*.parquet", skip_corrupt: bool = True) -> DataFrame:
    """Parquet files that have bytes; unreadable ones are skipped if asked. None left is an error."""
    found = file_sizes(spark, path, pattern)
    kept = [r.path for r in found.where("length > 0").orderBy("path").collect()]
    if not kept:
        raise FileNotFoundError(f"no file with data at {path}")
    return spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(*kept)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """An item table: all ``*.parquet`` files, or else those with ``c000`` names, by column name."""
    for pattern in ("*.parquet", "*c000"):
        if not file_sizes(spark, path, pattern).isEmpty():
            return spark.read.option("pathGlobFilter", pattern).parquet(path)
    raise FileNotFoundError(f"no item files at {path}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred (one more pass) unless a schema is given."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """TSV without a header."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def as_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def source_query(df: DataFrame, selects: dict[str, str], where: str | None = None) -> DataFrame:
    """An event source's select list (SQL expressions by name)."""
    out = df.where(F.expr(where)) if where else df
    return out.selectExpr(*[f"{e} as `{n}`" for n, e in selects.items()])
