"""Payloads of evaluation reports: histograms, box plots, confusion matrices, drift."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import numbered


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """Rows per bucket of equal width over [low, high); values outside go to bucket 0 or buckets + 1."""
    at = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Moments of a histogram message."""
    c = F.col(column).cast("double")
    return df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("num"), F.sum(c).alias("sum"),
        F.sum(c * c).alias("sum_squared"), F.stddev_pop(c).alias("std_dev"), F.avg(c).alias("average"),
    )


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, interpolated between neighbours; ``shares``: output name to share.

    Rows get their place in the order of keys and value over range partitions, and the two rows beside each quantile
    are picked by place, so no task holds the values of a group. Nulls are left out; a group of nulls only has null ones.
    """
    c = F.col(column).cast("double")
    named = df.select(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)], c.alias("value_"))
    own = [f"key{i}_" for i in range(len(keys))]
    placed = numbered(named.where("value_ is not null"), [*own, "value_"], "place_")
    ends = placed.groupBy(*own).agg(F.min("place_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    asked = F.array(*[F.struct(F.lit(n).alias("name_"), (F.lit(float(q)) * (F.col("n_") - 1)).alias("at_")) for n, q in shares.items()])
    wanted = ends.select(*own, "first_", F.inline(asked))
    low = F.floor("at_")
    share = F.col("at_") - low
    beside = F.array(F.struct((F.col("first_") + low).alias("place_"), (1 - share).alias("share_")), F.struct((F.col("first_") + low + 1).alias("place_"), share.alias("share_")))
    cells = wanted.select(*own, "name_", F.inline(F.filter(beside, lambda x: x["share_"] > 0)))
    found = cells.join(placed.select("place_", "value_"), "place_")
    wide = found.groupBy(*own).agg(*[F.sum(F.when(F.col("name_") == n, F.col("share_") * F.col("value_"))).alias(n) for n in shares])
    groups = named.select(*own).distinct()
    met = groups.alias("g").join(wide.alias("w"), reduce(and_, [F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}")) for k in own], F.lit(True)), "left")
    return met.select(*[F.col(f"g.{k}").alias(name) for k, name in zip(own, keys, strict=True)], *[F.col(f"w.{n}") for n in shares])


def box_plot(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Five-number summary per key."""
    return quantiles(df, keys, column, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_table(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row per class, zeros included: ``truth`` and ``counts``, an array in the order of ``classes``.

    Rows whose classes are not listed, or null, count nowhere.
    """
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], "place int, truth string")
    cells = F.array(*[F.count_if(F.col(predicted).cast("string") == c) for c in classes]).alias("found_")
    found = df.groupBy(F.col(truth).cast("string").alias("truth")).agg(cells)
    met = F.broadcast(names).join(found, "truth", "left")
    zeros = F.array(*[F.lit(0).cast("bigint") for _ in classes])
    return met.select("place", "truth", F.coalesce("found_", zeros).alias("counts"))


def bucket_limit(bucket: Column, low: float, high: float, buckets: int) -> Column:
    """The upper end of a histogram's bucket: ``low`` for bucket 0, infinity beyond the last."""
    width = (float(high) - float(low)) / buckets
    return F.when(bucket > buckets, F.lit(float("inf"))).otherwise(F.lit(float(low)) + bucket * F.lit(width))


def mean_or(c: Column, fallback: float) -> Column:
    """The mean of the values that are not null; ``fallback`` where there are none."""
    return F.coalesce(F.avg(c), F.lit(float(fallback)))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Entropy (nats) of a column's distribution."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select((F.ln("t") - F.col("s") / F.col("t")).alias("entropy"))


def psi(expected: DataFrame, actual: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """Population stability index of two tables over equal buckets."""
    a = histogram(expected, column, low, high, buckets).withColumnRenamed("n", "e")
    b = histogram(actual, column, low, high, buckets).withColumnRenamed("n", "a")
    met = a.join(b, "bucket", "full").fillna(0, ["e", "a"])
    totals = F.broadcast(met.agg(F.sum("e").alias("te"), F.sum("a").alias("ta")))  # one row
    p, q = (F.col("e") + 0.5) / (F.col("te") + 0.5), (F.col("a") + 0.5) / (F.col("ta") + 0.5)
    return met.join(totals).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def chart_metrics(charts: DataFrame) -> DataFrame:
    """name, value of charts (title, series array of arrays of doubles) with exactly one series of one point."""
    single = charts.where((F.size("series") == 1) & (F.size(F.col("series")[0]) == 1) & F.col("series")[0][0].isNotNull())
    return single.select(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("metric_"), F.col("position").cast("string"))).alias("name"), F.col("series")[0][0].alias("value"))
