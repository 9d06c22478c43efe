"""Padding, parsing and shaping of array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that stand for missing elements, by Spark type name.
SENTINELS = {"int": -2147483648, "bigint": -2147483648, "float": float("nan"), "double": float("nan"), "string": "", "binary": b"", "boolean": False}


def sentinel(type_: T.DataType):
    name = type_.simpleString()
    if name not in SENTINELS:
        raise ValueError(f"no sentinel for {name}")
    return F.lit(SENTINELS[name]).cast(type_)


def leaf_type(type_: T.DataType) -> T.DataType:
    while isinstance(type_, T.ArrayType):
        type_ = type_.elementType
    return type_


def pad_to(c: Column, size: Column | int, value: Column) -> Column:
    """The array filled up to a size; a null array is all filling."""
    size = F.lit(size) if isinstance(size, int) else size
    empty = F.coalesce(c, F.array())
    return F.concat(empty, F.array_repeat(value, F.greatest(F.lit(0), size - F.size(empty))))


def max_sizes(df: DataFrame, column: str) -> tuple[int, ...]:
    """The largest size at each level of a (nested) array column, from one aggregate over the table."""
    levels, rows, type_ = [], F.array(F.col(column)), df.schema[column].dataType
    while isinstance(type_, T.ArrayType):
        rows = F.filter(rows, lambda x: x.isNotNull())
        levels.append(F.coalesce(F.max(F.array_max(F.transform(rows, lambda x: F.size(x)))), F.lit(0)))
        rows, type_ = F.flatten(rows), type_.elementType
    return tuple(df.agg(*levels).first())


def _filled(c: Column, type_: T.DataType, sizes: tuple[int, ...], fill: Column) -> Column:
    if len(sizes) == 1:
        return pad_to(c, sizes[0], fill)
    blank = fill
    for size in reversed(sizes[1:]):
        blank = F.array_repeat(blank, size)
    inner = F.transform(F.coalesce(c, F.array().cast(type_)), lambda x: _filled(x, type_.elementType, sizes[1:], fill))
    return pad_to(inner, sizes[0], blank)


def padded(df: DataFrame, column: str, output: str, value: object = None) -> DataFrame:
    """A ragged array column of any depth filled up to the largest size per level."""
    type_ = df.schema[column].dataType
    leaf = leaf_type(type_)
    fill = sentinel(leaf) if value is None else F.lit(value).cast(leaf)
    return df.withColumn(output, _filled(F.col(column), type_, max_sizes(df, column), fill))


def parse_array(c: Column, dtype: str = "array<float>") -> Column:
    """An array from its text form, JSON or a Python list or tuple; unreadable text is null.

    Arrays of strings may be lists in either kind of quotes; tuples, None, True and False are read for other types.
    """
    if "string" in dtype:
        return F.from_json(c, dtype)
    plain = F.translate(c, "()", "[]")
    for literal, name in (("None", "null"), ("True", "true"), ("False", "false"), ("nan", "NaN"), ("inf", "Infinity")):
        plain = F.regexp_replace(plain, rf"\b{literal}\b", name)
    return F.from_json(F.regexp_replace(plain, r",\s*\]", "]"), dtype)


def mean_pooled(tokens: Column, mask: Column | None = None) -> Column:
    """The mean of token vectors, of those whose mask is not 0 where there is one; null where no token is left.

    ``tokens`` is an array of vectors of one size, ``mask`` an array of numbers as long.
    """
    if mask is not None:
        both = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: F.coalesce(x["m"], F.lit(0)) != 0)
        tokens = F.transform(both, lambda x: x["t"])
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("array<double>").alias("s"))

    def add(so_far: Column, v: Column) -> Column:
        v = F.transform(v, lambda x: x.cast("double"))
        return F.struct((so_far["n"] + 1).alias("n"), F.coalesce(F.zip_with(so_far["s"], v, lambda x, y: x + y), v).alias("s"))

    return F.aggregate(tokens, start, add, lambda found: F.transform(found["s"], lambda x: x / found["n"]))


def reshape_column(c: Column) -> Column:
    """A vector of N values as N rows of one."""
    return F.transform(c, lambda x: F.array(x))


def fixed_width(c: Column, size: int, value: Column) -> Column:
    """The set as exactly ``size`` values: cut or filled."""
    return F.slice(pad_to(c, size, value), 1, size)


def l2_normalised(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))
