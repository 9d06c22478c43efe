"""Windowed feature aggregation and point-in-time joins.

A window of W ending at t covers [t - W, t): a row sees neither itself nor rows at its own time. All
windows of one key share one shuffle and one sort. Times are whole microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import checkpointed, numbered

MICROS = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000}


@dataclass(frozen=True)
class TimeWindow:
    length: int
    unit: str = "days"

    @property
    def micros(self) -> int:
        return self.length * MICROS[self.unit]


@dataclass(frozen=True)
class Aggregation:
    """``op``: count sum average variance min max unique_count approx_unique_count."""

    column: str
    op: str
    windows: tuple[TimeWindow, ...] = ()


@dataclass(frozen=True)
class EventSource:
    """A table's select list and time column (microseconds)."""

    table: DataFrame
    selects: dict[str, str]
    time: str

    def rows(self) -> DataFrame:
        return self.table.selectExpr(*[f"{e} as `{n}`" for n, e in self.selects.items()], f"{self.time} as `time_us_`")


@dataclass(frozen=True)
class GroupBy:
    """Features of a source's rows by key."""

    source: EventSource
    keys: tuple[str, ...]
    aggregations: tuple[Aggregation, ...]


def feature_name(a: Aggregation, w: TimeWindow) -> str:
    return f"{a.op}_{a.column}_{w.length}{w.unit}"


_OPS = {
    "count": F.count, "sum": F.sum, "average": F.avg, "variance": F.var_pop, "min": F.min, "max": F.max,
    "approx_unique_count": F.approx_count_distinct,
}


def _over(a: Aggregation, c: Column, window) -> Column:
    if a.op == "unique_count":
        return F.size(F.collect_set(c).over(window)).cast("bigint")
    return _OPS[a.op](c).over(window)


def _tile(time: Column, longest: int) -> Column:
    """The tile of time, ``longest`` microseconds wide, that a time is in."""
    return ((time - F.pmod(time, F.lit(longest))) / F.lit(longest)).cast("bigint")


def _tiles(time: Column, longest: int) -> Column:
    """A row's own tile of time and the next one, whose rows may look back on it; without a time only its own."""
    own = _tile(time, longest)
    here, ahead = F.struct(own.alias("tile_"), F.lit(True).alias("own_")), F.struct((own + 1).alias("tile_"), F.lit(False).alias("own_"))
    return F.when(time.isNull(), F.array(here)).otherwise(F.array(here, ahead))


def _longest(aggregations: tuple[Aggregation, ...] | list[Aggregation]) -> int:
    return max((w.micros for a in aggregations for w in a.windows), default=1)


def trailing_windows(df: DataFrame, keys: list[str], time_us: Column, aggregations: list[Aggregation]) -> DataFrame:
    """Each row with its features over the windows before it.

    Time is cut into tiles as long as the longest window, and a task sorts one key's rows of a tile and of the tile
    before, whatever the length of the key's history. Copies in the next tile carry only key, time and features' columns.
    """
    needed = {*keys, *[a.column for a in aggregations], "time_us_"}
    out = df.withColumn("time_us_", time_us)
    names = out.columns
    out = out.select("*", F.inline(_tiles(F.col("time_us_"), _longest(aggregations))))
    out = out.select(*[F.col(f"`{c}`") if c in needed else F.when(F.col("own_"), F.col(f"`{c}`")).alias(c) for c in names], "tile_", "own_")
    base = Window.partitionBy(*keys, "tile_").orderBy("time_us_")
    for a in aggregations:
        for w in a.windows:
            out = out.withColumn(feature_name(a, w), _over(a, F.col(a.column), base.rangeBetween(-w.micros, -1)))
    return out.where("own_").drop("time_us_", "tile_", "own_")


def untimed(df: DataFrame, keys: list[str], aggregations: list[Aggregation]) -> DataFrame:
    """One row per key with all-time features, named without a window."""
    ops = _OPS | {"unique_count": F.count_distinct}
    return df.groupBy(*keys).agg(*[ops[a.op](a.column).alias(f"{a.op}_{a.column}") for a in aggregations])


def point_in_time(left: DataFrame, time_us: str, parts: list[tuple[str, GroupBy]]) -> DataFrame:
    """Left rows with the features of each part as of their own time; feature names get the part's prefix.

    Left and right rows of a part are put in one table and swept by one window per key and tile of time, so there is
    no range join; right rows stand in their own tile and the next, left rows in their own.
    """
    # several parts meet by row number; the checkpoint keeps it the same in every branch
    out = checkpointed(left.withColumn("row_", F.monotonically_increasing_id())) if len(parts) > 1 else left
    found = []
    for prefix, part in parts:
        values = list(dict.fromkeys(a.column for a in part.aggregations))
        tiles = _tiles(F.col("time_us_"), _longest(part.aggregations))
        right = part.source.rows().select("*", F.inline(tiles)).drop("own_")
        right = right.select(*part.keys, "time_us_", "tile_", F.lit(False).alias("left_"), *[F.col(v).alias(f"right_{v}") for v in values])
        base = out if len(parts) == 1 else out.select("row_", *part.keys, F.col(time_us).alias(time_us))
        mine = base.withColumns({"time_us_": F.col(time_us), "tile_": _tile(F.col(time_us), _longest(part.aggregations)), "left_": F.lit(True)})
        line = mine.unionByName(right, allowMissingColumns=True)
        window = Window.partitionBy(*part.keys, "tile_").orderBy("time_us_")
        for a in part.aggregations:
            for w in a.windows:
                c = F.col(f"right_{a.column}")
                line = line.withColumn(f"{prefix}_{feature_name(a, w)}", _over(a, c, window.rangeBetween(-w.micros, -1)))
        line = line.where("left_").drop("time_us_", "tile_", "left_", *[f"right_{v}" for v in values])
        found.append(line if len(parts) == 1 else line.drop(*part.keys, time_us))
    if len(parts) == 1:
        return found[0]
    return reduce(lambda a, b: a.join(b, "row_"), found, out).drop("row_")


def dense_index(values: DataFrame, column: str, output: str) -> DataFrame:
    """Distinct values with their place in order, from 0, counted over range partitions."""
    return numbered(values.select(column).where(F.col(column).isNotNull()).distinct(), [column], output)
