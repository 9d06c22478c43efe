"""Goldens of single operators."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, transforms
from millrace.operators import console, criteria, prep, schedule, selectors, vector
from millrace.plans import features, registry  # noqa: F401
from millrace.sources import readers, sinks
from millrace.streaming import ingest


def test_divide(spark):
    df = spark.createDataFrame([(10.0, 2.0), (10.0, 5.0), (10.0, 0.0), (0.0, 0.0)], "n double, d double")
    got = [r[0] for r in df.select(transforms.divide(F.col("n"), F.col("d"))).collect()]
    assert got == [5.0, 2.0, pytest.approx(1e8), 0.0]
    assert spark.range(1).select(transforms.divide(F.lit(10), F.lit(2), add=1.0)).first()[0] == pytest.approx(10 / 3)
    assert spark.range(1).select(transforms.divide(F.lit(10), F.lit(0), eps=0.5)).first()[0] == 20


def test_log(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (-1.0,), (-5.0,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(transforms.log_transform(F.col("x"))).collect()]
    assert got[:4] == [1.0, 1.0, pytest.approx(math.log(10)), 1.0]
    assert math.isnan(got[4]) and math.isnan(got[5])


def test_floor_and_ceil_pass_odd_values_through(spark):
    df = spark.createDataFrame([(1.5,), (-1.5,), (float("nan"),), (float("inf"),), (1e300,)], "x double")
    floors = [r[0] for r in df.select(transforms.floor(F.col("x"), "double")).collect()]
    assert floors[:2] == [1.0, -2.0] and math.isnan(floors[2]) and floors[3] == float("inf") and floors[4] == 1e300
    assert [r[0] for r in df.select(transforms.ceil(F.col("x"), "double")).collect()][:2] == [2.0, -1.0]


def test_vocabulary(spark):
    words = [-10, -3, 0, 2, 4, 6]
    df = spark.createDataFrame([(-10,), (0,), (5,), (None,)], "x long")
    assert [r[0] for r in df.select(transforms.vocabulary_index(F.col("x"), words)).collect()] == [0, 2, 6, 6]
    with pytest.raises(ValueError):
        transforms.vocabulary_index(F.col("x"), [])


def test_stack_and_constant(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert transforms.stacked(df, ["a", "b"], "m").first().m == [[1.0, 3.0], [2.0, 4.0]]
    assert transforms.stacked(df, ["a", "b"], "m", 1).first().m == [[1.0, 2.0], [3.0, 4.0]]
    assert transforms.constant(df, ["a"], ["c"], 7, "int").first().c == [7, 7]
    with pytest.raises(ValueError):
        transforms.stacked(df, ["a", "b"], "m", 0)


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],), (None,)], "a array<int>")
    assert [r.b for r in arrays.padded(df, "a", "b", 0).collect()] == [[1, 2, 3], [4, 0, 0], [0, 0, 0]]
    nested = spark.createDataFrame([([[1], [2, 3]],), ([[4]],)], "a array<array<int>>")
    assert [r.b for r in arrays.padded(nested, "a", "b", 0).collect()] == [[[1, 0], [2, 3]], [[4, 0], [0, 0]]]


def test_list_values_and_selectors():
    assert criteria.list_values("[a, b ,c]") == ["a", "b", "c"]
    assert [r.op for r in selectors.parse("a=1,b in (x, y),!c,d,e notin (z)")] == ["=", "in", "!exists", "exists", "notin"]
    for bad in ("a!=1", ",".join(f"k{i}" for i in range(27)), "a b"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


def test_criteria_errors():
    kind = criteria.Kind("pod", {"spec.state": "state"})
    assert kind.column("pod.metadata.update_timestamp") == "update_time"
    for name in ("spec.state", "pod.spec.other"):
        with pytest.raises(ValueError):
            kind.column(name)
    with pytest.raises(ValueError):
        criteria.compare(F.lit(1), "NEAR", "1")
    with pytest.raises(ValueError):
        criteria.compile_tree(criteria.Operation(logical="XOR"), kind, {}, {})


def test_bad_literal_matches_nothing(spark):
    kind = criteria.Kind("x", {"n": "n"})
    tree = criteria.Operation((criteria.Criterion("x.n", criteria.GT, "many"),))
    assert criteria.filter_objects(spark.range(3).toDF("n"), tree, kind).count() == 0
    assert criteria.filter_objects(spark.range(3).toDF("n"), criteria.Operation(), kind).count() == 3


def test_pages():
    assert criteria.next_token(10, 10, "20") == "30" and criteria.next_token(9, 10) == ""
    with pytest.raises(ValueError):
        criteria.page(None, [], 5, "x")


def test_grouping(spark):
    rows = [("Engineering", 5), ("Engineering", 3), ("Marketing", 8), ("Marketing", 2)]
    df = spark.createDataFrame(rows, "department string, n int")
    out = console.grouped(df, ["department"], {"sum": ("sum", "n"), "mean": ("mean", "n"), "extent": ("extent", "n")}).orderBy("department").collect()
    assert [(r.sum, r.mean, r.extent) for r in out] == [(8, 4.0, [3, 5]), (10, 5.0, [2, 8])]


def test_global_search_skips_falsy(spark):
    df = spark.createDataFrame([(0, "a"), (10, ""), (5, "x0")], "n int, s string")
    assert [r.n for r in console.global_search(df, "0").collect()] == [10, 5]


def test_cron():
    c = schedule.Cron("0 8 * * *")
    got = list(c.between(datetime(2024, 1, 1, 8), datetime(2024, 1, 3, 23, 59, 59)))
    assert got == [datetime(2024, 1, d, 8) for d in (1, 2, 3)]
    assert c.before(datetime(2024, 1, 2, 8)) == datetime(2024, 1, 1, 8)
    assert schedule.Cron("*/15 9-10 * * mon-fri").after(datetime(2024, 1, 5, 10, 45)) == datetime(2024, 1, 8, 9)
    assert schedule.previous_fire(datetime(2024, 1, 2), interval=timedelta(hours=1)) == datetime(2024, 1, 1, 23)
    assert schedule.Cron("0 0 31 2 *").after(datetime(2024, 1, 1)) is None
    assert schedule.trigger_kind(start=1, end=2, cron="x") == "backfill"


def test_vector_filters_are_penalties(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.0], "b")], "item_id long, embedding array<double>, cat string")
    queries = spark.createDataFrame([(7, [1.0, 0.0], ["b"])], "query_id long, query_embedding array<double>, cats array<string>")
    got = vector.search(queries, items, "query_id", "item_id", 5, vector.Filters({"cat": "cats"})).orderBy("rank").collect()
    assert [(r.item_id, round(r.score, 6)) for r in got] == [(2, 0.9), (1, 0.0)]
    whole = vector.search(queries, items, "query_id", "item_id", 2, vector.Filters({"cat": "cats"}), candidates=2)
    assert {(r.item_id, r.rank) for r in whole.collect()} == {(2, 1), (1, 2)}


def test_rules(spark):
    df = spark.createDataFrame([("a@b.c", "1.2.3.4", [1, 2]), ("nope", "::1", [1, 1]), (None, "1.2.3", None)], "mail string, ip string, xs array<int>")
    got = {(r["column"], r.rule): r.violations for r in prep.violations(df, {"mail": {"required": None, "email": None}, "ip": {"ip": None}, "xs": {"unique_items": None}}).collect()}
    assert got == {("mail", "required"): 1, ("mail", "email"): 1, ("ip", "ip"): 1, ("xs", "unique_items"): 1}


def test_upsert_keeps_sticky_columns(spark):
    schema = "key long, seq long, name string, state string"
    old = spark.createDataFrame([(1, 1, "first", "new"), (2, 1, "b", "new")], schema)
    new = spark.createDataFrame([(1, 5, "renamed", "done"), (1, 4, "x", "late"), (3, 1, "c", "new")], schema)
    got = {tuple(r) for r in ingest.upsert(old, new).collect()}
    assert got == {(1, 5, "first", "done"), (2, 1, "b", "new"), (3, 1, "c", "new")}


def test_labels_are_replaced(spark):
    side = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "obj_uid long, key string, value string")
    new = spark.createDataFrame([(1, "b", "z")], side.schema)
    assert {tuple(r) for r in ingest.replace_side_rows(side, new, new).collect()} == {(2, "a", "y"), (1, "b", "z")}


def test_empty_files_are_left_out(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "part-empty.parquet").touch()
    assert readers.read_parquet_nonempty(spark, str(tmp_path / "t")).count() == 3
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.parquet").touch()
    with pytest.raises(FileNotFoundError):
        readers.read_parquet_nonempty(spark, str(tmp_path / "none"))


def test_sinks_check_their_settings(spark):
    with pytest.raises(ValueError):
        sinks.FileSink("x", "xml")
    with pytest.raises(ValueError):
        sinks.MemorySink(limit=2).write(spark.range(5))


def test_assembled_collision(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        prep.assembled(df, {"id": F.lit(1)}, raise_on_collision=True)


def test_whole_vector_queries_take_their_share_of_the_table(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(3)
    first = 10**12
    vectors = {first + i: [r.uniform(-1, 1) for _ in range(3)] for i in range(2_400)}
    spark.createDataFrame([(i, v, i % 5) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vector, "QUERY_BLOCK", 20)  # three blocks
    asked = [i for i in vectors if i % 50 == 0]
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True))
    soft = lambda q, i: (q % 5 == i % 5) - 1 + (i % 4 == q % 4) + (i % 3 == q % 4) - 1 - (i < q - 500) - (i > q + 1500)
    score = lambda q, i: dot(q, i) + soft(q, i)
    best = lambda q, of, k, found=vectors: sorted(found, key=lambda i: (-of(q, i), i))[:k]
    ranks = lambda name: {(x.query_id, x.rank): x.item_id for x in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    want = lambda found: {(q, k + 1): i for q in asked for k, i in enumerate(found(q))}
    assert len(asked) == 48
    assert ranks("vec_topk_whole") == want(lambda q: best(q, dot, 10))
    assert ranks("vec_topk_filtered_whole") == want(lambda q: best(q, score, 5))
    assert ranks("vec_two_stage_whole") == want(lambda q: best(q, score, 10, best(q, soft, 50)))
    far = lambda q, i: -max(dot(q, q) + dot(i, i) - 2 * dot(q, i), 1e-6)
    assert ranks("vec_euclid_whole") == want(lambda q: best(q, far, 5))
    share = sum(q in best(q, dot, 3) for q in asked) / len(asked)
    assert registry.QUERIES["hit_rate_at_k_whole"](spark, str(tmp_path)).first().hit_rate == round(share, 6)


def test_numbered_takes_texts_and_times(spark):
    from millrace.operators import prep

    rows = [(f"k{i % 7}", f"2024-01-{i % 28 + 1:02d}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    for order in (["k", "i"], ["t", "i"], [F.col("k").desc(), "i"]):
        got = [r.i for r in prep.numbered(df, order, "place").orderBy("place").collect()]
        assert got == [r.i for r in df.orderBy(*order).collect()]
    assert [prep.positional_split(df, ["k", "i"]).where(F.col("split") == s).count() for s in ("train", "validation", "test")] == [40, 5, 5]


def test_strict_cast_raises(spark):
    from millrace.functions import transforms

    df = spark.createDataFrame([("1",), (None,), ("x",)], "a string")
    assert [r.b for r in transforms.cast_columns(df, ["a"], ["b"], strict=False).collect()] == [1, None, None]
    assert [r.b for r in transforms.cast_columns(df.where("a is null or a = '1'"), ["a"], ["b"]).collect()] == [1, None]
    with pytest.raises(Exception, match="can't be cast"):
        transforms.cast_columns(df, ["a"], ["b"]).collect()


def test_file_sink_refuses_odd_prefixes():
    from millrace.sources.sinks import FileSink

    for path in ("", "s3://", "s3:///x", "s3://bucket//x"):
        with pytest.raises(ValueError):
            FileSink(path)
    assert FileSink("s3://bucket/x/").path == "s3://bucket/x"
