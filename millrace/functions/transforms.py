"""Elementwise feature transforms as Column builders; each takes and returns columns by name.

All stay inside generated code: no Python runs per row. Types are kept per column (inputs of one layer are
not promoted to a common type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-7
#: Beyond this magnitude every double is whole.
_WHOLE = float(2**53)


def _same_length(inputs: list[str], outputs: list[str]) -> None:
    if len(inputs) != len(outputs) or not inputs:
        raise ValueError("as many output as input columns are needed, and at least one")


def concatenated(df: DataFrame, inputs: list[str], output: str, dtype: str | None = None) -> DataFrame:
    """Scalars to one vector, or vectors end to end."""
    if len(inputs) < 1:
        raise ValueError("no input columns")
    vectors = [isinstance(df.schema[c].dataType, T.ArrayType) for c in inputs]
    if any(vectors) != all(vectors):
        raise ValueError("scalars and vectors can't be concatenated")
    joined = F.concat(*inputs) if all(vectors) else F.array(*inputs)
    return df.withColumn(output, joined.cast(f"array<{dtype}>") if dtype else joined)


def stacked(df: DataFrame, inputs: list[str], output: str, dim: int = -1) -> DataFrame:
    """Vectors of one length to a matrix of doubles: columns (-1) or rows (1) of it."""
    as_double = [F.col(c).cast("array<double>") for c in inputs]
    if dim == 1:
        return df.withColumn(output, F.array(*as_double))
    if dim != -1:
        raise ValueError("rows can be stacked along 1 or -1 only")
    positions = F.sequence(F.lit(1), F.size(inputs[0]))
    empty = F.array().cast("array<array<double>>")
    cells = F.transform(positions, lambda i: F.array(*[F.element_at(c, i) for c in as_double]))
    return df.withColumn(output, F.when(F.size(inputs[0]) == 0, empty).otherwise(cells))


def cast_columns(df: DataFrame, inputs: list[str], outputs: list[str], dtype: str = "bigint", strict: bool = True) -> DataFrame:
    """Cast, toward zero for numbers; what can't be cast fails the query, or is null where not ``strict``."""
    _same_length(inputs, outputs)

    def one(name: str) -> Column:
        done = F.col(name).try_cast(dtype)
        if not strict:
            return done
        text = F.concat(F.lit(f"{name} can't be cast to {dtype}: "), F.col(name).cast("string"))
        return F.when(done.isNull() & F.col(name).isNotNull(), F.raise_error(text).cast(dtype)).otherwise(done)

    return df.withColumns({o: one(i) for i, o in zip(inputs, outputs, strict=True)})


def constant(df: DataFrame, inputs: list[str], outputs: list[str], value: object, dtype: str) -> DataFrame:
    """A constant in the shape of each input: scalar, or vector of the input's length."""
    _same_length(inputs, outputs)
    lit = F.lit(value).cast(dtype)
    shaped = lambda c: F.transform(c, lambda _: lit) if isinstance(df.schema[c].dataType, T.ArrayType) else lit
    return df.withColumns({o: shaped(i) for i, o in zip(inputs, outputs, strict=True)})


def divide(n: Column, d: Column, add: float = 0.0, eps: float = EPS) -> Column:
    """n / (d + add) as double; a zero divisor is eps, zero by zero is 0."""
    n, d = n.cast("double"), d.cast("double") + F.lit(add)
    return F.when((n == 0) & (d == 0), F.lit(0.0)).otherwise(n / F.when(d == 0, F.lit(eps)).otherwise(d))


def log_transform(x: Column, add: float = 1.0) -> Column:
    """ln(x + add) held between 1 and 1e20; NaN for negative arguments."""
    y = x.cast("double") + F.lit(add)
    nan = F.lit(float("nan"))
    held = F.greatest(F.lit(1.0), F.least(F.lit(1e20), F.ln(y)))
    return F.when(F.isnan(y) | (y < 0), nan).when(y == 0, F.lit(1.0)).otherwise(held)


def subtract(a: Column, b: Column) -> Column:
    return a.cast("double") - b.cast("double")


def subtract_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def _rounded(c: Column, dtype: str, how) -> Column:
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return c
    whole = F.isnan(c) | (F.abs(c) >= F.lit(_WHOLE))
    return F.when(whole, c).otherwise(how(F.when(~whole, c)).cast(dtype))


def floor(c: Column, dtype: str) -> Column:
    """The floor in the input's type."""
    return _rounded(c, dtype, F.floor)


def ceil(c: Column, dtype: str) -> Column:
    """The ceiling in the input's type."""
    return _rounded(c, dtype, F.ceil)


def identity(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    _same_length(inputs, outputs)
    return df.withColumns({o: F.col(i) for i, o in zip(inputs, outputs, strict=True)})


def vocabulary_index(c: Column, vocabulary: list[int]) -> Column:
    """Place of the value's first occurrence in a short vocabulary; its size for unknown values."""
    if not vocabulary or not all(isinstance(v, int) for v in vocabulary):
        raise ValueError("a vocabulary holds at least one integer, and only integers")
    known = F.array(*[F.lit(v).cast("bigint") for v in vocabulary])
    return F.coalesce(F.nullif(F.array_position(known, c.cast("bigint")), F.lit(0)) - 1, F.lit(len(vocabulary))).cast("bigint")


def vocabulary_indexed(df: DataFrame, inputs: list[str], outputs: list[str], vocabulary: list[int]) -> DataFrame:
    """``vocabulary_index`` of columns of integers or arrays of them, of any depth; the integer type is kept."""
    _same_length(inputs, outputs)

    def placed(c: Column, type_: T.DataType) -> Column:
        if isinstance(type_, T.ArrayType):
            return F.transform(c, lambda x: placed(x, type_.elementType))
        if not isinstance(type_, T.IntegralType):
            raise ValueError(f"integers are needed, not {type_.simpleString()}")
        return vocabulary_index(c, vocabulary).cast(type_)

    return df.withColumns({o: placed(F.col(i), df.schema[i].dataType) for i, o in zip(inputs, outputs, strict=True)})


def vocabulary_join(df: DataFrame, column: str, vocabulary: DataFrame, output: str, size: int) -> DataFrame:
    """The same for a long vocabulary, a table (value, place): a left join on its first places."""
    first = vocabulary.groupBy("value").agg(F.min("place").alias("place_"))
    met = df.join(first, df[column] == first["value"], "left")
    return met.withColumn(output, F.coalesce("place_", F.lit(size)).cast("bigint")).drop("value", "place_")


def is_null(c: Column) -> Column:
    return c.isNull()


def string_length(c: Column) -> Column:
    return F.length(c)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def min_max_scaled(df: DataFrame, column: str, output: str) -> DataFrame:
    """The column scaled to [0, 1] by its extremes; a constant column is 0."""
    ends = F.broadcast(df.agg(F.min(column).cast("double").alias("lo_"), F.max(column).cast("double").alias("hi_")))  # one row
    met = df.join(ends)
    return met.withColumn(output, F.when(F.col("hi_") > F.col("lo_"), (F.col(column) - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0))).otherwise(F.lit(0.0))).drop("lo_", "hi_")
