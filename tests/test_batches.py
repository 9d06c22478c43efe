"""Batch functions, custom aggregates, external scorers, lookups and report sinks."""

from __future__ import annotations

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import batches, criteria, report, vector
from millrace.sources import sinks
from millrace.streaming import ingest

# workers get what is defined here by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Numbers the calls of one instance."""

    def __init__(self, start=0):
        self.calls = start

    def __call__(self, rows):
        self.calls += 1
        return {"id": rows["id"], "call": np.full(len(rows["id"]), self.calls)}


def test_batches_have_the_asked_size_and_a_class_is_made_once_per_partition(spark):
    out = batches.map_batches(spark.range(0, 25, 1, 1), Counting, "id bigint, call bigint", 10, {"start": 100}).collect()
    assert [(r.id, r.call) for r in out] == [(i, 101 + i // 10) for i in range(25)]
    many = batches.map_batches(spark.range(0, 40, 1, 8), Counting, "id bigint, call bigint", 10, tasks=2)
    assert many.rdd.getNumPartitions() == 2 and many.count() == 40


def test_nulls_and_vectors_pass_through_batches(spark):
    df = spark.createDataFrame([(2**60 + 1, [1.0, 2.0]), (None, [3.0, 4.0])], "n bigint, v array<double>").coalesce(1)
    out = batches.map_batches(df, lambda rows: {"n": rows["n"], "w": np.stack(rows["v"]) * 2}, "n bigint, w array<double>").collect()
    assert [(r.n, r.w) for r in out] == [(2**60 + 1, [2.0, 4.0]), (None, [6.0, 8.0])]
    assert batches.map_batches(df.limit(0), lambda rows: rows, "n bigint, v array<double>").collect() == []


def test_dotted_paths_and_wrong_arguments(spark):
    assert batches.resolved("json.dumps") is json.dumps
    with pytest.raises(ValueError):
        batches.resolved("dumps")
    with pytest.raises(ValueError):
        batches.map_batches(spark.range(1), lambda rows: rows, "id bigint", init={"a": 1})


class Spread(batches.Aggregate):
    state, result = "low bigint, high bigint", "bigint"

    def start(self, rows):
        known = [v for v in rows["v"] if v is not None]
        return {"low": min(known, default=None), "high": max(known, default=None)}

    def merge(self, states):
        low, high = ([v for v in states[c] if v is not None] for c in ("low", "high"))
        return {"low": min(low, default=None), "high": max(high, default=None)}

    def finish(self, state):
        return None if state["low"] is None else state["high"] - state["low"]


def test_custom_aggregate_keeps_null_keys_and_splits_a_hot_one(spark):
    rows = [("hot", i) for i in range(1000)] + [(None, 5), (None, 9), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(7)
    out = {r.k: r.d for r in batches.aggregate_by(df, ["k"], ["v"], Spread(), "d", spread=3).collect()}
    assert out == {"hot": 999, None: 4, "none": None}
    assert [r.d for r in batches.aggregate_by(df, [], ["v"], Spread(), "d").collect()] == [999]
    assert batches.aggregate_by(df.limit(0), ["k"], ["v"], Spread(), "d").collect() == []
    with pytest.raises(ValueError):
        batches.aggregate_by(df, ["k"], ["v"], Spread(), "k")


def test_external_scorer_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(60)] + [(60, None)]
    asked = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(7)]
    q = spark.createDataFrame(asked, "query_id bigint, query_embedding array<double>")
    e = spark.createDataFrame(items, "item_id bigint, embedding array<double>")
    scorer = lambda a, b: -((a - b) ** 2).sum(axis=1)
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in vector.search_scored(q, e, "query_id", "item_id", scorer, 61).collect()}
    for qid, v in asked:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in items if w is not None)
        assert [got[qid, r + 1] for r in range(60)] == [(i, -d) for d, i in want]
        assert got[qid, 61] == (60, None)
    few = vector.search_scored(q, e, "query_id", "item_id", lambda m: m[:, 0], 2, candidates=3, joined=True)
    assert few.groupBy("query_id").count().where("count <> 2").isEmpty() and few.count() == 14


def test_result_shape_keeps_queries_without_results(spark):
    q = spark.createDataFrame([(1, [1.0], "a"), (2, [1.0], "b")], "query_id int, query_embedding array<double>, tag string")
    found = spark.createDataFrame([(1, 8, 0.5, 2), (1, 9, 0.75, 1)], "query_id int, item_id int, score double, rank int")
    out = {r.tag: json.loads(r.predictions) for r in vector.results_json(found, "query_id", "item_id", q).collect()}
    assert out == {"a": [{"item_id": 9, "score": 0.75}, {"item_id": 8, "score": 0.5}], "b": []}


def test_mean_with_fallback_and_training_texts(spark):
    assert spark.range(0).agg(report.mean_or(F.col("id"), float("inf")).alias("m")).first().m == float("inf")
    one = lambda **c: spark.createDataFrame([tuple(c.values())], list(c))
    said = lambda df: df.select(text.training_text(df, "<e>").alias("t")).first().t
    assert said(one(instruction="i", input="c", output="o")) == "### Instruction:\ni\n\n### Input:\nc\n\n### Response:\no<e>"
    assert said(one(instruction="i", output="o")) == "### Instruction:\ni\n\n### Response:\no<e>"
    assert said(one(question="q", answer="a")) == "Question: q\nAnswer: a<e>"
    assert said(one(text="x")) == "x<e>"
    assert said(one(other=1)) == '{"other":1}<e>'


def test_lookups_that_find_nothing(spark):
    objects = spark.createDataFrame([("u1", "n", "a", None), ("u2", "n", "b", "2024")], "uid string, namespace string, name string, delete_time string")
    assert criteria.one(criteria.by_uid(objects, "u1")).name == "a"
    with pytest.raises(LookupError):
        criteria.one(criteria.by_uid(objects, "u2"))
    keys = spark.createDataFrame([("u2",)], "uid string")
    assert ingest.soft_delete(objects, keys, F.lit("2025"), "uid").count() == 2
    with pytest.raises(LookupError):
        ingest.soft_delete(objects, keys, F.lit("2025"), "uid", must_exist=True)


def test_report_sinks(spark, tmp_path):
    report_ = {"metadata": {"name": "r1"}, "rows": 3}
    path = sinks.ReportSink(f"{tmp_path}/reports").write(spark, report_, {"rows": 4})
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"metadata": {"name": "r1"}, "rows": 4}]
    with pytest.raises(ValueError):
        sinks.ReportSink(str(tmp_path)).write(spark, {"rows": 1})
    sent = []
    sinks.CallReportSink(sent.append).write(spark, report_)
    assert sent == [report_]
