"""Tiles of windows, quantiles by place, the change log, nested padding, literals and pooling on small fixtures."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import arrays, transforms
from millrace.operators import console, features, report
from millrace.streaming import ingest

HOUR = features.MICROS["hours"]


def test_windows_of_a_hot_key_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 4 else "cold", int(rng.integers(-40, 60)) * HOUR // 4, float(rng.integers(0, 9))) for i in range(400)]
    rows += [(900, "hot", None, 1.0), (901, None, 5, 2.0), (902, None, 9, None)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint, v double").withColumn("extra", F.lit("x"))
    asked = [features.Aggregation("v", op, (features.TimeWindow(1, "hours"), features.TimeWindow(6, "hours"))) for op in ("count", "sum")]
    out = features.trailing_windows(df, ["k"], F.col("t"), asked)
    assert out.columns == [*df.columns, "count_v_1hours", "count_v_6hours", "sum_v_1hours", "sum_v_6hours"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for i, k, t, _ in rows:
        if t is None:
            continue
        for hours in (1, 6):
            seen = [v for _, k2, t2, v in rows if k2 == k and t2 is not None and t - hours * HOUR <= t2 < t and v is not None]
            assert got[i][f"count_v_{hours}hours"] == len(seen)
            assert got[i][f"sum_v_{hours}hours"] == (sum(seen) if seen else None)
        assert got[i].extra == "x"


def test_point_in_time_over_several_tiles(spark):
    left = spark.createDataFrame([(1, "a", 0), (2, "a", 10 * HOUR), (3, "b", 3 * HOUR), (4, "a", 2 * HOUR), (5, "c", None)], "id int, k string, at bigint")
    right = spark.createDataFrame([("a", -HOUR, 1.0), ("a", HOUR, 2.0), ("a", 9 * HOUR, 4.0), ("b", 3 * HOUR, 8.0), ("b", HOUR, 16.0)], "k string, t bigint, v double")
    part = features.GroupBy(features.EventSource(right, {"k": "k", "v": "v"}, "t"), ("k",), (features.Aggregation("v", "sum", (features.TimeWindow(2, "hours"),)),))
    for parts in ([("p", part)], [("p", part), ("q", part)]):
        got = {r.id: r.p_sum_v_2hours for r in features.point_in_time(left, "at", parts).collect()}
        assert got == {1: 1.0, 2: 4.0, 3: 16.0, 4: 2.0, 5: None}


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=101), "b": rng.integers(0, 3, 50).astype(float), None: np.array([4.0]), "c": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("empty", None), ("a", None)]
    out = report.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.0, "mid": 0.5, "p90": 0.9, "high": 1.0})
    got = {r.g: r for r in out.collect()}
    assert got.keys() == groups.keys() | {"empty"} and got["empty"].mid is None
    for g, vs in groups.items():
        assert np.allclose(got[g][1:], np.quantile(vs, [0.0, 0.5, 0.9, 1.0]))
    assert report.box_plot(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_change_log_with_bases_equals_one_fold(spark, tmp_path):
    schema = "key string, seq bigint, create_time timestamp_ntz, state string"
    batches = [[(f"k{i % 3}", 10 * n + i, datetime(2024, 1, 1 + n), f"s{n}{i}") for i in range(n % 2, 5)] for n in range(5)]
    batches[3].append(("k0", 1, datetime(2023, 1, 1), "late"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    ingest.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", compact_every=2).awaitTermination()
    got = {r.key: (r.seq, r.state) for r in ingest.read_snapshot(spark, f"{tmp_path}/out", 4, compact_every=2).collect()}
    best = {}
    for key, seq, _, state in (r for b in batches for r in b):
        best[key] = max(best.get(key, (-1, "")), (seq, state))
    assert got == best
    assert {p.name for p in (tmp_path / "out" / "base").iterdir() if p.is_dir()} == {"batch=1", "batch=3"}
    firsts = {r.create_time for r in ingest.read_snapshot(spark, f"{tmp_path}/out", 4, compact_every=2).collect()}
    assert firsts == {datetime(2024, 1, 1)}
    early = ingest.read_snapshot(spark, f"{tmp_path}/out", 0, compact_every=2)
    assert early.count() == 3 and ingest.read_snapshot(spark, f"{tmp_path}/out", -1) is None


def test_padding_of_three_levels_with_nulls(spark):
    rows = [(1, [[[1], None], None]), (2, [[[1, 2]]]), (3, None), (4, [])]
    out = arrays.padded(spark.createDataFrame(rows, "id int, a array<array<array<int>>>"), "a", "b", 0).orderBy("id").collect()
    blank = [[0, 0], [0, 0]]
    assert [r.b for r in out] == [[[[1, 0], [0, 0]], blank], [[[1, 2], [0, 0]], blank], [blank, blank], [blank, blank]]


def test_literals(spark):
    texts = ["[1, 2.5]", "(1, None, -inf,)", "nothing", None, "[nan]", "()"]
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(arrays.parse_array(F.col("t"), "array<double>").alias("a")).collect()]
    assert got[0] == [1.0, 2.5] and got[1] == [1.0, None, float("-inf")] and got[2] is None and got[3] is None and got[4][0] != got[4][0] and got[5] == []
    assert spark.range(1).select(arrays.parse_array(F.lit("['a', \"None\"]"), "array<string>").alias("a")).first().a == ["a", "None"]


def test_pooling_without_tokens(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]], [1, 1]), ([[1.0, 2.0], [3.0, 6.0]], [0, None]), ([], []), (None, None)], "t array<array<float>>, m array<int>")
    assert [r.p for r in df.select(arrays.mean_pooled(F.col("t"), F.col("m")).alias("p")).collect()] == [[2.0, 4.0], None, None, None]


def test_vocabulary_keeps_the_integer_type(spark):
    df = spark.createDataFrame([(7, [[7, 9], [1]])], "a smallint, b array<array<int>>")
    out = transforms.vocabulary_indexed(df, ["a", "b"], ["x", "y"], [9, 7])
    assert out.select("x", "y").first() == (1, [[1, 0], [2]])
    assert out.schema["x"].dataType.simpleString() == "smallint" and out.schema["y"].dataType.simpleString() == "array<array<int>>"


def test_paths_of_cells(spark):
    df = spark.sql("select named_struct('b', array(named_struct('c', 5))) as a")
    assert df.select(console.accessor("a.b[0].c"), console.accessor("a.b[4].c", 9)).first() == (5, 9)
