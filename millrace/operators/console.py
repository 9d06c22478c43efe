"""Table semantics: global search, categorical and time filters, grouping aggregates, sorting, pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(c: Column, type_: T.DataType) -> Column:
    """The cell as text: JSON for nested types, else its string."""
    return F.to_json(c) if isinstance(type_, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def _falsy(c: Column, type_: T.DataType) -> Column:
    if isinstance(type_, T.BooleanType):
        return ~c
    if isinstance(type_, T.NumericType):
        return c == 0
    return c == "" if isinstance(type_, T.StringType) else F.lit(False)


def global_search(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any cell contains the term, ignoring case; null, zero, false and empty cells never match."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    hits = [
        F.coalesce(~_falsy(F.col(f.name), f.dataType) & F.contains(F.lower(as_text(F.col(f.name), f.dataType)), F.lit(term.lower())), F.lit(False))
        for f in fields
    ]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False)))


def categorical(df: DataFrame, column: str, values: list[str], exclude: bool = False) -> DataFrame:
    """Rows whose stringified value is among the selected ones; ``exclude`` inverts; no values: all rows."""
    if not values:
        return df
    chosen = F.col(column).cast("string").isin(*values)
    return df.where(F.coalesce(~chosen, F.lit(True)) if exclude else chosen)


def time_range(df: DataFrame, column: Column, bounds: list[str]) -> DataFrame:
    """Rows with a timestamp in [from, to]; anything but two bounds is ignored."""
    if len(bounds) != 2:
        return df
    return df.where(column.between(F.lit(bounds[0]).cast("timestamp_ntz"), F.lit(bounds[1]).cast("timestamp_ntz")))


#: Grouping aggregates by name.
AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "extent": lambda c: F.array(F.min(c), F.max(c)),
    "mean": F.avg,
    "median": F.median,
    "unique": lambda c: F.array_sort(F.collect_set(c)),
    "uniqueCount": F.count_distinct,
}


def grouped(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggregates``: output name to (aggregate's name, column)."""
    return df.groupBy(*keys).agg(*[AGGREGATES[how](F.col(c)).alias(name) for name, (how, c) in aggregates.items()])


def mean_rounded(c: str, digits: int = 2) -> Column:
    return F.round(F.avg(c), digits)


def sorted_page(df: DataFrame, order: list[tuple[str, bool]], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) sorted by (column, descending); nulls last in both directions."""
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    return df.orderBy(*keys).offset(page * size).limit(size)


def display_order(values: DataFrame, column: str, selected: list[str]) -> DataFrame:
    """Selected values first, each part in alphabetical order."""
    return values.orderBy(F.col(column).isin(*selected).desc(), F.lower(column), column)


def accessor(path: str, default: object = None) -> Column:
    """A nested cell by path, as ``a.b[0].c``, with a default for null; a place beyond an array's end is null."""
    first, *steps = re.findall(r"[^.\[\]]+|\[\d+\]", path)
    c = F.col(f"`{first}`")
    for step in steps:
        c = F.get(c, F.lit(int(step[1:-1]))) if step.startswith("[") else c[step]
    return c if default is None else F.coalesce(c, F.lit(default))


def flattened(df: DataFrame) -> DataFrame:
    """One column per leaf of nested structs, named by its dotted path."""

    def leaves(schema: T.StructType, at: str) -> list[Column]:
        out = []
        for f in schema.fields:
            path = f"{at}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, path + ".")
            else:
                out.append(F.col(path).alias(path.replace("`", "")))
        return out

    return df.select(*leaves(df.schema, ""))
