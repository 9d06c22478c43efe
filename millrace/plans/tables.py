"""Queries over console tables, preparation, schedules, reports and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import console, prep, report, schedule
from millrace.plans.registry import query, table
from millrace.plans.scratch import scratch
from millrace.sources import readers, sinks


@query("staging_left_join", """SELECT l_orderkey, l_linenumber, p_name AS title, CAST(l_quantity AS DOUBLE) AS score, epoch_us(date_trunc('day', l_shipdate)) // 1000 AS ts
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_name IS NOT NULL AND l_quantity IS NOT NULL AND p_brand = 'Brand#1'""")
def staging_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    met = met.where("p_name is not null and l_quantity is not null and p_brand = 'Brand#1'")
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    return met.select("l_orderkey", "l_linenumber", F.col("p_name").alias("title"), F.col("l_quantity").cast("double").alias("score"), text.epoch_millis(day).alias("ts"))


@query("semi_join_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("global_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%' OR lower(p_brand) LIKE '%re%' OR lower(p_type) LIKE '%re%'")
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.global_search(table(spark, sf_dir, "part"), "Re", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("categorical_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def categorical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.categorical(table(spark, sf_dir, "events"), "event_type", ["click", "error"]).select("event_id")


@query("categorical_exclude", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'error')")
def categorical_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.categorical(table(spark, sf_dir, "events"), "event_type", ["click", "error"], exclude=True).select("event_id")


@query("datetime_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def datetime_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.time_range(table(spark, sf_dir, "events"), F.col("ts"), ["2024-01-05", "2024-01-09 12:00:00"]).select("event_id", "ts")


@query("group_agg_console", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 4) AS mean,
  median(l_quantity) AS mid, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1""")
def group_agg_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = console.grouped(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {
        "n": ("count", "l_quantity"), "total": ("sum", "l_quantity"), "extent": ("extent", "l_quantity"), "mean": ("mean", "l_quantity"),
        "mid": ("median", "l_quantity"), "statuses": ("unique", "l_linestatus"), "days": ("uniqueCount", "l_shipdate"),
    })
    return out.select(
        "l_returnflag", "n", F.round("total", 4).alias("total"), F.col("extent")[0].alias("low"), F.col("extent")[1].alias("high"), F.round("mean", 4).alias("mean"),
        "mid", F.array_join("statuses", ",").alias("statuses"), "days",
    )


@query("console_page", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey ASC LIMIT 20 OFFSET 40")
def console_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.sorted_page(table(spark, sf_dir, "part"), [("p_size", True), ("p_partkey", False)], 2, 20).select("p_partkey", "p_brand", "p_size")


@query("custom_mean", "SELECT p_brand, round(avg(p_size) + 1.23e-7, 2) AS m FROM part GROUP BY 1")
def custom_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("s", F.col("p_size") + 1.23e-7).groupBy("p_brand").agg(console.mean_rounded("s").alias("m"))


@query("flatten_nested", "SELECT p_partkey AS \"id\", p_name AS \"a.name\", p_size AS \"a.b.size\" FROM part")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size")).alias("b")).alias("a"))
    return console.flattened(nested)


@query("negative_pairs", "SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM (SELECT p_partkey FROM part ORDER BY 1 LIMIT 101) a, (SELECT p_partkey FROM part ORDER BY 1 LIMIT 101) b WHERE a.p_partkey <> b.p_partkey ORDER BY 1, 2 LIMIT 100")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.negative_pairs(table(spark, sf_dir, "part"), "p_partkey", 100)


@query("pair_union", "SELECT p_partkey AS id, 1 AS label FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size > 45")
def pair_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda where, label: p.where(where).select(F.col("p_partkey").alias("id"), F.lit(label).alias("label"))
    return pick("p_size < 5", 1).unionByName(pick("p_size > 45", 0))


@query("length_stats", "SELECT CAST(min(n_chars) AS BIGINT) AS min_len, CAST(max(n_chars) AS BIGINT) AS max_len, round(avg(n_chars), 4) AS avg_len FROM documents")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.length_stats(table(spark, sf_dir, "documents"), F.col("n_chars")).withColumn("avg_len", F.round("avg_len", 4))


@query("length_band", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 1000")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.length_band(table(spark, sf_dir, "documents"), F.length("text"), 100, 1000).select("doc_id")


@query("split_positional", """SELECT split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE WHEN p < CAST(floor(t * 0.8) AS BIGINT) THEN 'train' WHEN p < CAST(floor(t * 0.8) AS BIGINT) + CAST(floor(t * 0.1) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS t FROM orders)) GROUP BY 1""")
def split_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = prep.positional_split(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("split_temporal", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1995-12-31' THEN 'train' WHEN o_orderdate <= TIMESTAMP '1996-12-31' THEN 'validation' ELSE 'test' END AS split FROM orders")
def split_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.temporal_split(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "1995-12-31", "1996-12-31").select("o_orderkey", "split")


@query("split_hash")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.hash_split(table(spark, sf_dir, "orders"), "o_orderkey", {"train": 0.8, "validation": 0.1, "test": 0.1}).select("o_orderkey", "split")


@query("sample_hash")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: one percent of the orders."""
    return prep.hash_sampled(table(spark, sf_dir, "orders"), "o_orderkey", 0.01).select("o_orderkey")


@query("validate_rules", """SELECT 'c_acctbal' AS "column", 'min' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS violations FROM customer
UNION ALL SELECT 'c_name', 'pattern', count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#0*[1-9]+$')) FROM customer
UNION ALL SELECT 'c_mktsegment', 'in', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer
UNION ALL SELECT 'c_mktsegment', 'max_length', count(*) FILTER (WHERE length(c_mktsegment) > 9) FROM customer""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.violations(table(spark, sf_dir, "customer"), {
        "c_acctbal": {"min": 0}, "c_name": {"pattern": "^Customer#0*[1-9]+$"}, "c_mktsegment": {"in": ("BUILDING", "MACHINERY"), "max_length": 9},
    })


@query("validate_schema", "SELECT 'embedding: ' || CAST(count(*) AS VARCHAR) || ' rows are not 32 long at level 0' AS problem FROM embeddings UNION ALL SELECT 'missing column score' UNION ALL SELECT 'label is int, not STRING'")
def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = {"vec_id": ("LONG", ()), "embedding": ("FLOAT", (32,)), "label": ("STRING", ()), "score": ("DOUBLE", ())}
    return spark.createDataFrame([(p,) for p in prep.schema_errors(table(spark, sf_dir, "embeddings"), expected)], "problem string")


@query("assemble_output", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, l_tax + 1 AS prediction FROM lineitem")
def assemble_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.assembled(
        table(spark, sf_dir, "lineitem"), {"prediction": F.col("l_tax") + 1, "l_quantity": F.col("l_quantity") * 2}, ["l_orderkey", "l_linenumber", "l_quantity"]
    )


_START, _END = datetime(2024, 1, 1), datetime(2024, 1, 3, 23, 59, 59)


@query("cron_fires", "SELECT ts FROM (VALUES (TIMESTAMP '2024-01-01 08:00:00'), (TIMESTAMP '2024-01-02 08:00:00'), (TIMESTAMP '2024-01-03 08:00:00')) v(ts)")
def cron_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.fire_times(spark, _START, _END, cron="0 8 * * *")


@query("backfill_grid", "SELECT CAST(ts AS TIMESTAMP) AS ts, r_name AS param FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 23:59:59', INTERVAL 6 HOUR) g(ts), region")
def backfill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = schedule.fire_times(spark, _START, _END, interval=timedelta(hours=6))
    return schedule.backfill_grid(fires, table(spark, sf_dir, "region").select(F.col("r_name").alias("param")))


@query("batch_assign", "SELECT n_nationkey, n_name, CAST((row_number() OVER (ORDER BY n_name) - 1) // 10 AS BIGINT) AS batch FROM nation")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.batches(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name"])


@query("histogram", "SELECT CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 9 ELSE floor((l_quantity - 5) / 5) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5, 45, 8)


@query("box_plot", "SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1")
def box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.box_plot(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "low", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "high")


@query("confusion_matrix", "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("entropy", "WITH c AS (SELECT count(*) AS n FROM events GROUP BY event_type), t AS (SELECT sum(n) AS t FROM c) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c, t")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.entropy(table(spark, sf_dir, "events"), "event_type").select(F.round("entropy", 6).alias("entropy"))


@query("summary_moments", "SELECT min(value) AS min, max(value) AS max, count(value) AS num, round(sum(value), 4) AS sum, round(stddev_pop(value), 6) AS std_dev FROM events")
def summary_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.summary(table(spark, sf_dir, "events"), "value")
    return out.select("min", "max", "num", F.round("sum", 4).alias("sum"), F.round("std_dev", 6).alias("std_dev"))


_NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("sink_roundtrip_parquet", _NATION_SQL)
def sink_roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink-parquet")
    sinks.push(table(spark, sf_dir, "nation"), [sinks.ParquetSink(path, partition_by=("n_regionkey",)), sinks.MemorySink()])
    return readers.read_parquet(spark, path, columns=["n_nationkey", "n_name", "n_regionkey"])


@query("sink_roundtrip_csv", _NATION_SQL)
def sink_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink-csv")
    sinks.FileSink(path, "csv").write(table(spark, sf_dir, "nation"))
    return readers.read_csv(spark, path, _NATION)


@query("sink_roundtrip_json", _NATION_SQL)
def sink_roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink-json")
    sinks.FileSink(path, "json").write(table(spark, sf_dir, "nation"))
    return readers.read_json(spark, path, _NATION)
