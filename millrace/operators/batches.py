"""Functions over batches of rows: plain functions, stateful classes, collate functions and mergeable aggregates.

Rows reach Python as Arrow batches and are handed on as dicts of numpy columns; a column with nulls comes as objects,
so that whole numbers stay whole. Batch functions shuffle nothing. Aggregates send one state per key and batch.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]


def resolved(fn: Callable | type | str) -> Callable | type:
    """A callable, or the one that a dotted path names."""
    if not isinstance(fn, str):
        return fn
    module, _, name = fn.rpartition(".")
    if not module:
        raise ValueError(f"{fn!r} is not a dotted path")
    return getattr(importlib.import_module(module), name)


def _numpy(table: pa.RecordBatch | pa.Table) -> Columns:
    out = {}
    for name, column in zip(table.schema.names, table.columns):
        if column.null_count:
            cells = np.empty(len(column), dtype=object)
            cells[:] = column.to_pylist()
            out[name] = cells
        else:
            out[name] = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return out


def _arrow(columns: Columns, schema: pa.Schema) -> pa.RecordBatch:
    if set(columns) != set(schema.names):
        raise ValueError(f"columns {sorted(columns)} instead of {sorted(schema.names)}")
    arrays = []
    for f in schema:
        cells = columns[f.name]
        nested = getattr(cells, "ndim", 1) > 1
        arrays.append(pa.array(list(cells) if nested else cells, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows in the order of a partition; only its last one is shorter."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_batches(
    df: DataFrame, fn: Callable | type | str, schema: str, batch_size: int = 1024, init: dict | None = None, tasks: int | None = None
) -> DataFrame:
    """``fn`` over the rows in batches; ``schema`` names the columns it returns, of any number of rows.

    ``fn`` takes and returns a dict of columns. A class is made once per partition with the arguments of ``init`` and
    then called, so that a model is loaded once; ``tasks`` bounds how many of them live at once. A dotted path names
    either, which is how a collate function is plugged in. Partitions without rows call nothing.
    """
    if batch_size < 1:
        raise ValueError("batch_size is at least 1")
    fn, arguments = resolved(fn), dict(init or {})
    if arguments and not isinstance(fn, type):
        raise ValueError("only a class takes init")
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for rows in _sized(batches, batch_size):
            if call is None:
                call = fn(**arguments) if isinstance(fn, type) else fn
            yield _arrow(call(_numpy(rows)), out)

    return (df if tasks is None else df.coalesce(tasks)).mapInArrow(run, schema)


class Aggregate:
    """A mergeable aggregate: ``state`` names its columns, ``result`` the type of its value.

    ``start`` makes the state of some rows of one key, ``merge`` one state of several, ``finish`` the value of the
    last one. Merging must not depend on how rows were split or ordered.
    """

    state: str
    result: str

    def start(self, rows: Columns) -> dict:
        raise NotImplementedError

    def merge(self, states: Columns) -> dict:
        raise NotImplementedError

    def finish(self, state: dict) -> object:
        raise NotImplementedError


def _parts(batch: pa.RecordBatch, keys: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of each key of a batch; null is a key too."""
    codes = np.zeros((batch.num_rows, 1 + len(keys)), dtype=np.int64)
    for i, k in enumerate(keys):
        codes[:, i + 1] = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    _, inverse = np.unique(codes, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.argsort(inverse, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1)


def aggregate_by(df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, output: str, spread: int = 256) -> DataFrame:
    """keys and ``output``: a custom aggregate of ``columns`` by key (null is a key); one row per key that has rows.

    States are made per key and Arrow batch before any shuffle, merged in up to ``spread`` parts per key and then once
    more, so that a key of any number of rows is never in one task as rows.
    """
    if {"spread_", output} & {*keys, *columns} or {f.name for f in StructType.fromDDL(aggregate.state)} & {"spread_", *keys}:
        raise ValueError("keys, columns, state and output need names of their own")
    states = StructType.fromDDL(aggregate.state)
    held = df.select(*keys, *columns)
    key_schema = StructType([held.schema[k] for k in keys])
    middle = StructType(key_schema.fields + states.fields)
    last = StructType(key_schema.fields + StructType.fromDDL(f"`{output}` {aggregate.result}").fields)
    state_arrow, last_arrow = to_arrow_schema(middle), to_arrow_schema(last)
    names = [f.name for f in states]

    def rows_of(found: list[pa.RecordBatch], values: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        firsts = pa.Table.from_batches(found)
        arrays = [firsts.column(k).combine_chunks().cast(schema.field(k).type) for k in keys]
        arrays += [pa.array([v[f.name] for v in values], f.type) for f in list(schema)[len(keys) :]]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, found = [], []
                cells = _numpy(batch.select(columns))
                for rows in _parts(batch, keys):
                    values.append(aggregate.start({c: cells[c][rows] for c in columns}))
                    found.append(batch.slice(int(rows[0]), 1))
                yield rows_of(found, values, state_arrow)

    def merge(table: pa.Table) -> pa.Table:
        one = aggregate.merge(_numpy(table.select(names)))
        return pa.Table.from_batches([rows_of(table.slice(0, 1).to_batches(), [one], state_arrow)])

    def finish(table: pa.Table) -> pa.Table:
        value = aggregate.finish(aggregate.merge(_numpy(table.select(names))))
        return pa.Table.from_batches([rows_of(table.slice(0, 1).to_batches(), [{output: value}], last_arrow)])

    started = held.mapInArrow(start, middle).withColumn("spread_", F.pmod(F.spark_partition_id(), F.lit(spread)))
    return started.groupBy(*keys, "spread_").applyInArrow(merge, middle).groupBy(*keys).applyInArrow(finish, last)
