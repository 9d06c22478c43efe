"""Preparation for training: splits, samples, padding checks, validation, output assembly, pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordering import numbered


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42, output: str = "split") -> DataFrame:
    """Rows assigned to named parts by a hash of their key: the same under any partitioning."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000)
    at, c = 0.0, None
    names = list(shares)
    for n in names[:-1]:
        at += shares[n]
        c = F.when(u < at, n) if c is None else c.when(u < at, n)
    return df.withColumn(output, F.lit(names[-1]) if c is None else c.otherwise(names[-1]))


def positional_split(df: DataFrame, order: list[str], train: float = 0.8, validation: float = 0.1, output: str = "split") -> DataFrame:
    """The first share of the rows in order to train, the next to validation, the rest to test; shares are cut to whole rows.

    Order keys may be numbers, texts or times. Places come from running counts over range partitions, so no task
    holds all rows.
    """
    n = df.count()
    first, second = int(n * train), int(n * train) + int(n * validation)
    place = numbered(df, order, "place_")
    c = F.when(F.col("place_") < first, "train").when(F.col("place_") < second, "validation").otherwise("test")
    return place.withColumn(output, c).drop("place_")


def temporal_split(df: DataFrame, time: Column, train_until: str, validation_until: str, output: str = "split") -> DataFrame:
    """Up to the first bound train, up to the second validation, later test."""
    a, b = F.lit(train_until).cast("timestamp_ntz"), F.lit(validation_until).cast("timestamp_ntz")
    return df.withColumn(output, F.when(time <= a, "train").when(time <= b, "validation").otherwise("test"))


def sampled(df: DataFrame, fraction: float, seed: int, limit: int | None = None) -> DataFrame:
    out = df.sample(False, fraction, seed)
    return out if limit is None else out.limit(limit)


def hash_sampled(df: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """A sample by a hash of the key: the same under any partitioning."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(fraction * 1_000_000))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order by hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def length_band(df: DataFrame, size: Column, low: int, high: int) -> DataFrame:
    return df.where(size.between(low, high))


def length_stats(df: DataFrame, size: Column) -> DataFrame:
    """Smallest, largest and mean length; zeros for no rows."""
    return df.agg(
        F.coalesce(F.min(size), F.lit(0)).cast("bigint").alias("min_len"), F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_len"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"),
    )


def needed_columns(inputs: list[str], labels: list[str], metadata: list[str]) -> list[str]:
    """The scan's columns: sorted, each once."""
    return sorted({*inputs, *labels, *metadata})


def assembled(df: DataFrame, predictions: dict[str, Column], keep: list[str] | None = None, extras: dict[str, Column] | None = None, raise_on_collision: bool = False) -> DataFrame:
    """Passed-through columns (all, or those kept), predictions and extras; a clash overwrites in place or raises."""
    new = {**predictions, **(extras or {})}
    base = [c for c in df.columns if not keep or c in keep]
    if raise_on_collision and (clash := sorted(set(base) & set(new))):
        raise ValueError(f"columns occur twice: {', '.join(clash)}")
    order = base + [c for c in new if c not in base]
    return df.withColumns(new).select(*order)


def tiered(c: Column, tiers: list[tuple[float, str]], rest: str) -> Column:
    """The first tier whose bound the value reaches."""
    out = None
    for bound, name in tiers:
        out = F.when(c >= bound, name) if out is None else out.when(c >= bound, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def negative_pairs(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n pairs of different rows, by the two keys.

    The first n pairs only need the first keys: rows k (k - 1) >= n of them, at least two.
    """
    rows = 2
    while rows * (rows - 1) < n:
        rows += 1
    ids = df.select(key).distinct().orderBy(key).limit(max(rows, n + 1))
    a, b = ids.select(F.col(key).alias("left_id")), ids.select(F.col(key).alias("right_id"))
    return a.join(F.broadcast(b), F.col("left_id") != F.col("right_id")).orderBy("left_id", "right_id").limit(n)


def rating_norm(c: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return (c - low) / (high - low)


#: Row rules: name to a predicate builder. Each holds for null unless it is ``required``.
RULES = {
    "required": lambda c, _: c.isNotNull(),
    "min": lambda c, v: c >= v,
    "max": lambda c, v: c <= v,
    "exclusive_min": lambda c, v: c > v,
    "exclusive_max": lambda c, v: c < v,
    "min_length": lambda c, v: F.length(c) >= v,
    "max_length": lambda c, v: F.length(c) <= v,
    "min_items": lambda c, v: F.size(c) >= v,
    "max_items": lambda c, v: F.size(c) <= v,
    "unique_items": lambda c, _: F.size(c) == F.size(F.array_distinct(c)),
    "pattern": lambda c, v: F.rlike(c, F.lit(v)),
    "not_pattern": lambda c, v: ~F.rlike(c, F.lit(v)),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "uuid": lambda c, _: F.rlike(c, F.lit("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
    "email": lambda c, _: F.rlike(c, F.lit("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")),
    "uri": lambda c, _: F.rlike(c, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$")),
    "ipv4": lambda c, _: F.rlike(c, F.lit("^((25[0-5]|2[0-4]\\d|1?\\d?\\d)(\\.(?!$)|$)){4}$")),
    "ipv6": lambda c, _: F.rlike(c, F.lit("^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=.*::)(?!.*::.*::)([0-9a-fA-F]{0,4}:){1,7}[0-9a-fA-F]{0,4})$")),
    "hostname": lambda c, _: F.rlike(c, F.lit("^(?=.{1,253}$)([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$")),
    "each": lambda c, rules: F.forall(c, lambda x: _all(x, rules)),
    "each_key": lambda c, rules: F.forall(F.map_keys(c), lambda x: _all(x, rules)),
    "each_value": lambda c, rules: F.forall(F.map_values(c), lambda x: _all(x, rules)),
}
RULES["ip"] = lambda c, v: RULES["ipv4"](c, v) | RULES["ipv6"](c, v)
RULES["host_address"] = lambda c, v: RULES["ip"](c, v) | RULES["hostname"](c, v)


def _all(c: Column, rules: dict) -> Column:
    out = F.lit(True)
    for name, value in rules.items():
        one = RULES[name](c, value)
        out = out & (one if name == "required" else F.coalesce(one, F.lit(True)))
    return out


def violations(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows that break a rule, per column and rule: one aggregate over the table."""
    checks = [(c, name, value) for c, own in rules.items() for name, value in own.items()]
    counts = [F.count_if(~F.coalesce(RULES[name](F.col(c), value), F.lit(name != "required"))).alias(f"v{i}") for i, (c, name, value) in enumerate(checks)]
    wide = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(name).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (c, name, _) in enumerate(checks)])
    return wide.select(F.inline(rows))


#: Logical types and the Spark types a column of them may have.
LOGICAL = {
    "BOOLEAN": ("boolean",), "STRING": ("string", "date", "timestamp", "timestamp_ntz", "binary"), "BYTE": ("tinyint",), "CHAR": ("smallint", "tinyint"),
    "SHORT": ("smallint", "tinyint"), "INT": ("int", "smallint", "tinyint"), "LONG": ("bigint", "int", "smallint", "tinyint"),
    "FLOAT": ("float", "int", "bigint", "smallint", "tinyint"), "DOUBLE": ("double", "float", "int", "bigint", "smallint", "tinyint"),
}


def schema_errors(df: DataFrame, expected: dict[str, tuple[str, tuple[int, ...]]]) -> list[str]:
    """What a table breaks of a declared schema: column sets, types, ranks, and fixed dimensions (one aggregate).

    ``expected``: column to (logical type, shape); a dimension of -1 is free.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing column {c}" for c in sorted(expected.keys() - found.keys())] + [f"unexpected column {c}" for c in sorted(found.keys() - expected.keys())]
    checks = []
    wrong = lambda size: lambda x: F.size(x) != size
    for c in sorted(expected.keys() & found.keys()):
        logical, shape = expected[c]
        type_, rank = found[c], 0
        while isinstance(type_, T.ArrayType):
            type_, rank = type_.elementType, rank + 1
        if type_.simpleString() not in LOGICAL[logical]:
            out.append(f"{c} is {type_.simpleString()}, not {logical}")
        if rank != len(shape):
            out.append(f"{c} has rank {rank}, not {len(shape)}")
            continue
        for level, size in enumerate(shape):
            if size >= 0:
                inner = F.array(F.col(c)) if level == 0 else reduce(lambda a, _: F.flatten(a), range(level - 1), F.col(c))
                checks.append((c, level, size, F.count_if(F.exists(inner, wrong(size)))))
    if checks:
        counts = df.agg(*[n.alias(f"n{i}") for i, (*_, n) in enumerate(checks)]).first()
        out += [f"{c}: {n} rows are not {size} long at level {level}" for (c, level, size, _), n in zip(checks, counts, strict=True) if n]
    return out
