"""Selector strings: ``key=value,key in (a,b),!key`` over labels, and over fields."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.criteria import Kind

#: Most requirements of one selector.
MAX_REQUIREMENTS = 26


@dataclass(frozen=True)
class Requirement:
    """``op`` is one of = in notin exists !exists."""

    key: str
    op: str
    values: tuple[str, ...] = ()


_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?"
_SET = re.compile(rf"^({_NAME})\s+(in|notin)\s*\(([^()]*)\)$")
_EQUAL = re.compile(rf"^({_NAME})\s*(==|!=|=)\s*(.*)$")


def parse(selector: str) -> list[Requirement]:
    """Requirements of a selector, parted by commas outside parentheses."""
    parts = [p.strip() for p in re.split(r",(?![^()]*\))", selector) if p.strip()]
    if len(parts) > MAX_REQUIREMENTS:
        raise ValueError(f"more than {MAX_REQUIREMENTS} requirements")
    out = []
    for p in parts:
        if m := _SET.match(p):
            out.append(Requirement(m[1], m[2], tuple(v.strip() for v in m[3].split(","))))
        elif m := _EQUAL.match(p):
            if m[2] == "!=":
                raise ValueError(f"unsupported operator in {p!r}")
            out.append(Requirement(m[1], "=", (m[3].strip(),)))
        elif re.fullmatch(rf"!\s*{_NAME}", p):
            out.append(Requirement(p[1:].strip(), "!exists"))
        elif re.fullmatch(_NAME, p):
            out.append(Requirement(p, "exists"))
        else:
            raise ValueError(f"can't read requirement {p!r}")
    return out


def select_by_labels(objects: DataFrame, labels: DataFrame, selector: str, uid: str = "uid") -> DataFrame:
    """Objects whose labels meet all requirements: semi-joins for the positive ones, anti-joins for the others.

    ``notin`` keeps objects that lack the key.
    """
    out = objects
    for r in parse(selector):
        hit = labels.where(F.col("key") == r.key)
        if r.op in ("=", "in", "notin"):
            hit = hit.where(F.col("value").isin(*r.values))
        how = "left_anti" if r.op in ("notin", "!exists") else "left_semi"
        out = out.join(hit.select(F.col("obj_uid").alias(uid)), uid, how)
    return out.select(objects.columns)


def select_by_fields(selector: str, kind: Kind) -> Column | None:
    """Field requirements (``=``, ``==`` and ``in``) as a predicate; an empty value means null or empty."""
    found = None
    for r in parse(selector):
        if r.op not in ("=", "in"):
            raise ValueError(f"unsupported operator {r.op!r} for fields")
        c = F.col(kind.column(r.key)).cast("string")
        one = c.isNull() | (c == "") if r.op == "=" and r.values == ("",) else c.isin(*r.values)
        found = one if found is None else found & one
    return found


def list_objects(objects: DataFrame, kind: Kind, labels: DataFrame, operation=None, label_selector: str = "", field_selector: str = "") -> DataFrame:
    """With an operation tree both selector strings are ignored; else both must be met."""
    from millrace.operators.criteria import filter_objects

    if operation is not None:
        return filter_objects(objects, operation, kind, labels)
    if field_selector and (predicate := select_by_fields(field_selector, kind)) is not None:
        objects = objects.where(predicate)
    return select_by_labels(objects, labels, label_selector, kind.uid) if label_selector else objects
