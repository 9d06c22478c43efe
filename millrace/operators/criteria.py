"""Criterion trees over object tables: compiled to one Column, with labels joined as flags or semi-joins.

A node holds field and label criteria and child nodes, joined by its one logical operator. Fields are
named ``<kind>.<field>`` and resolved through a map; unknown names are errors. Values are strings and
are cast to the column's type; a value that can't be cast matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

EQUAL, NOT_EQUAL, GT, GTE, LT, LTE, LIKE, IN, NOT_IN, IS_NULL, IS_NOT_NULL = (
    "EQUAL", "NOT_EQUAL", "GREATER_THAN", "GREATER_THAN_OR_EQUAL_TO", "LESS_THAN", "LESS_THAN_OR_EQUAL_TO", "LIKE", "IN", "NOT_IN", "IS_NULL", "IS_NOT_NULL",
)
AND, OR = "AND", "OR"
#: Names that stand for system columns of any kind.
ALIASES = {"metadata.creation_timestamp": "create_time", "metadata.update_timestamp": "update_time"}


@dataclass(frozen=True)
class Criterion:
    """One comparison of a field, or of a label's value if ``label`` is set."""

    name: str
    op: str
    value: str | None = None
    label: bool = False


@dataclass(frozen=True)
class Operation:
    """Criteria and children joined by ``logical``; without any of them it holds for all rows."""

    criteria: tuple[Criterion, ...] = ()
    logical: str = AND
    children: tuple["Operation", ...] = ()


@dataclass(frozen=True)
class Kind:
    """A table of objects: its name in field paths, the map of indexed paths to columns, its id column."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    uid: str = "uid"

    def column(self, path: str) -> str:
        prefix, _, rest = path.partition(".")
        if prefix != self.name or not rest:
            raise ValueError(f"field {path!r} does not begin with {self.name!r}")
        found = self.fields.get(rest) or ALIASES.get(rest)
        if found is None:
            raise ValueError(f"field {path!r} is not indexed")
        return found


def clean_value(value: str | bytes | None) -> str | None:
    """A match value: text as it is; raw bytes keep letters, digits and ``- _ . , space`` only."""
    if isinstance(value, bytes):
        return re.sub(r"[^a-zA-Z0-9\-_. ,]", "", value.decode("utf-8", "ignore"))
    return value


def list_values(value: str) -> list[str]:
    """The members of a list in text form: brackets around it go, members are trimmed."""
    return [v.strip() for v in value.strip(" [](){}").split(",")]


def compare(c: Column, op: str, value: str | bytes | None, type_: str = "string") -> Column:
    """The comparison as a Column under SQL's three-valued logic."""
    value = clean_value(value)
    if op == IS_NULL:
        return c.isNull()
    if op == IS_NOT_NULL:
        return c.isNotNull()
    if value is None:
        raise ValueError(f"{op} needs a value")
    cast = lambda v: F.lit(v) if type_ == "string" else F.lit(v).try_cast(type_)
    simple = {EQUAL: c.__eq__, NOT_EQUAL: c.__ne__, GT: c.__gt__, GTE: c.__ge__, LT: c.__lt__, LTE: c.__le__}
    if op in simple:
        return simple[op](cast(value))
    if op == LIKE:
        return c.cast("string").like(f"%{value}%")
    if op == IN:
        return c.isin(*[cast(v) for v in list_values(value)])
    if op == NOT_IN:
        return ~c.isin(*[cast(v) for v in list_values(value)])
    raise ValueError(f"unsupported operator {op!r}")


def _label_criteria(node: Operation) -> list[Criterion]:
    return [c for c in node.criteria if c.label] + [c for child in node.children for c in _label_criteria(child)]


def compile_tree(node: Operation, kind: Kind, types: dict[str, str], flags: dict[Criterion, str]) -> Column | None:
    """The tree as one predicate; label criteria are the boolean columns named in ``flags``. None if empty."""
    if node.logical not in (AND, OR):
        raise ValueError(f"unsupported logical operator {node.logical!r}")
    parts = []
    for c in (c for c in node.criteria if not c.label):
        name = kind.column(c.name)
        parts.append(compare(F.col(name), c.op, c.value, types.get(name, "string")))
    parts += [F.col(flags[c]) for c in node.criteria if c.label]
    parts += [p for child in node.children if (p := compile_tree(child, kind, types, flags)) is not None]
    if not parts:
        return None
    return reduce(lambda a, b: a & b if node.logical == AND else a | b, parts)


def _conjuncts(node: Operation) -> list[Criterion]:
    """Label criteria that every row must meet: those reached through AND nodes only."""
    if node.logical != AND:
        return []
    return [c for c in node.criteria if c.label] + [c for child in node.children for c in _conjuncts(child)]


def label_matches(labels: DataFrame, c: Criterion) -> DataFrame:
    """obj_uid of the objects that have the label with such a value."""
    return labels.where((F.col("key") == c.name) & compare(F.col("value"), c.op, c.value)).select("obj_uid")


def filter_objects(objects: DataFrame, node: Operation | None, kind: Kind, labels: DataFrame | None = None) -> DataFrame:
    """Objects that meet the tree. Required label criteria are semi-joins, those under OR are joined as flags."""
    if node is None:
        return objects
    wanted = _label_criteria(node)
    if wanted and labels is None:
        raise ValueError("label criteria need the label table")
    must = set(_conjuncts(node))
    out, flags = objects, {}
    for c in dict.fromkeys(wanted):
        hit = label_matches(labels, c).withColumnRenamed("obj_uid", kind.uid)
        flags[c] = name = f"label_{len(flags)}_"
        if c in must:
            out = out.join(hit, kind.uid, "left_semi").withColumn(name, F.lit(True))
        else:
            out = out.join(hit.distinct().withColumn(name, F.lit(True)), kind.uid, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    predicate = compile_tree(node, kind, dict(objects.dtypes), flags)
    out = out if predicate is None else out.where(predicate)
    return out.select(objects.columns)


@dataclass(frozen=True)
class OrderBy:
    """A sort key; any direction but ``DESC`` is ascending."""

    name: str
    direction: str = "ASC"


def ordering(orders: list[OrderBy], kind: Kind) -> list[Column]:
    """Sort columns; null comes first ascending and last descending."""
    out = []
    for o in orders:
        c = F.col(kind.column(o.name))
        out.append(c.desc_nulls_last() if o.direction.upper() == "DESC" else c.asc_nulls_first())
    return out


def order_by_label(objects: DataFrame, labels: DataFrame, key: str, kind: Kind, descending: bool = True, inner: bool = False) -> tuple[DataFrame, Column]:
    """Objects with the label's value as ``label_value`` and the sort column. ``inner`` drops objects without it."""
    values = labels.where(F.col("key") == key).select(F.col("obj_uid").alias(kind.uid), F.col("value").alias("label_value"))
    out = objects.join(values, kind.uid, "inner" if inner else "left")
    return out, F.col("label_value").desc_nulls_last() if descending else F.col("label_value").asc_nulls_first()


def page(df: DataFrame, order: list[Column], limit: int = 0, continue_token: str = "") -> DataFrame:
    """One page in a total order. The offset (the token) only counts with a limit; bad tokens are errors."""
    try:
        offset = int(continue_token or 0)
    except ValueError:
        raise ValueError(f"bad continue token {continue_token!r}") from None
    if offset < 0 or limit < 0:
        raise ValueError("limit and token can't be negative")
    df = df.orderBy(*order)
    if not limit:
        return df
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def next_token(rows: int, limit: int, continue_token: str = "") -> str:
    """The token after a page: set whenever the page was full."""
    return str(int(continue_token or 0) + limit) if limit and rows == limit else ""


def live(objects: DataFrame, namespace: str = "") -> DataFrame:
    """Objects that are not deleted, of one namespace or all."""
    out = objects.where(F.col("delete_time").isNull())
    return out.where(F.col("namespace") == namespace) if namespace else out


def by_name(objects: DataFrame, namespace: str, name: str) -> DataFrame:
    """The live object of that namespace and name."""
    return live(objects, namespace).where(F.col("name") == name).limit(1)


def by_uid(objects: DataFrame, uid: str) -> DataFrame:
    """The live object of that uid."""
    return live(objects).where(F.col("uid") == uid).limit(1)


def one(found: DataFrame, what: str = "object") -> Row:
    """The single row of a lookup; LookupError where there is none."""
    row = found.first()
    if row is None:
        raise LookupError(f"{what} not found")
    return row


def latest(objects: DataFrame, n: int, since: Column | None = None, time: str = "create_time", key: str = "uid") -> DataFrame:
    """The n newest objects: sorted, then cut."""
    out = objects if since is None else objects.where(F.col(time) >= since)
    return out.orderBy(F.desc_nulls_last(time), key).limit(n)


def case_insensitive(c: Column) -> Column:
    """The column under a collation that ignores case."""
    return F.collate(c, "UTF8_LCASE")
