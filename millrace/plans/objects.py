"""Queries over objects and their labels. ``orders`` and ``customer`` stand for object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import criteria as C
from millrace.operators import selectors
from millrace.operators.criteria import Criterion, Kind, Operation
from millrace.plans.registry import query, table
from millrace.streaming import ingest

ORDER = Kind(
    "order",
    {
        "spec.status": "state", "spec.price": "price", "spec.priority": "priority", "metadata.name": "name", "metadata.namespace": "namespace",
        "spec.owner": "owner",
    },
)
PART = Kind("part", {"spec.name": "p_name", "spec.brand": "p_brand", "spec.type": "p_type", "spec.size": "p_size"}, uid="p_partkey")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects: every seventh is deleted, every fifth has no state."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("uid"), F.concat(F.lit("ns"), F.pmod("o_custkey", F.lit(4)).cast("string")).alias("namespace"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.col("o_orderstatus")).alias("state"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("create_time"), F.when(F.pmod("o_orderkey", F.lit(7)) == 0, F.col("o_orderdate")).alias("delete_time"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a status for all orders, a priority for all but every third."""
    o = table(spark, sf_dir, "orders")
    status = o.select(F.col("o_orderkey").alias("obj_uid"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"))
    some = o.where(F.pmod("o_orderkey", F.lit(3)) != 0)
    return status.unionByName(some.select(F.col("o_orderkey").alias("obj_uid"), F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value")))


_OBJECTS = """o AS (
  SELECT o_orderkey AS uid, 'ns' || CAST(o_custkey % 4 AS VARCHAR) AS namespace, 'order-' || CAST(o_orderkey AS VARCHAR) AS name,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS state, o_totalprice AS price, o_orderpriority AS priority, o_custkey AS owner,
    o_orderdate AS create_time, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS delete_time FROM orders
), l AS (
  SELECT o_orderkey AS obj_uid, 'status' AS key, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0
)"""
_SHOWN = ("uid", "namespace", "name", "state", "price")


def _sql(rest: str) -> str:
    return f"WITH {_OBJECTS} {rest}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN)


@query("criteria_and_or_nested", _sql("""SELECT uid, namespace, name, state, price FROM o
WHERE delete_time IS NULL AND state = 'F' AND (priority = '1-URGENT' OR price >= 200000) ORDER BY create_time DESC, uid LIMIT 20"""))  # fmt: skip
def criteria_and_or_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation(
        (Criterion("order.spec.status", C.EQUAL, "F"),), C.AND,
        (Operation((Criterion("order.spec.priority", C.EQUAL, "1-URGENT"), Criterion("order.spec.price", C.GTE, "200000")), C.OR),),
    )
    found = C.filter_objects(C.live(objects(spark, sf_dir)), tree, ORDER)
    order = C.ordering([C.OrderBy("order.metadata.creation_timestamp", "DESC")], ORDER) + [F.col("uid")]
    return _shown(C.page(found, order, 20))


@query("doc_live_by_name", _sql("SELECT uid, namespace, name, state, price FROM o WHERE delete_time IS NULL AND namespace = 'ns1' AND name = (SELECT min(name) FROM o WHERE namespace = 'ns1' AND delete_time IS NULL)"))
def doc_live_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    name = C.live(o, "ns1").agg(F.min("name")).first()[0]
    return _shown(C.by_name(o, "ns1", name))


@query("doc_by_state", _sql("SELECT uid, namespace, name, state, price FROM o WHERE delete_time IS NULL AND state = 'P'"))
def doc_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((Criterion("order.spec.status", C.EQUAL, "P"),))
    return _shown(C.filter_objects(C.live(objects(spark, sf_dir)), tree, ORDER).orderBy(F.desc("create_time"), "uid"))


@query("doc_join_labels", _sql("SELECT uid, name, value FROM o JOIN l ON uid = obj_uid AND key = 'priority' AND value = '2-HIGH' WHERE delete_time IS NULL"))
def doc_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = labels(spark, sf_dir).where("key = 'priority' and value = '2-HIGH'")
    return C.live(objects(spark, sf_dir)).join(hit, F.col("uid") == F.col("obj_uid")).select("uid", "name", "value")


@query("doc_soft_deleted", _sql("SELECT uid, name, delete_time FROM o WHERE delete_time IS NOT NULL"))
def doc_soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where(F.col("delete_time").isNotNull()).orderBy(F.desc("create_time"), "uid").select("uid", "name", "delete_time")


@query("cli_list_100", _sql("SELECT uid, namespace, name, state, price FROM o WHERE delete_time IS NULL ORDER BY create_time DESC, uid LIMIT 100"))
def cli_list_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = C.ordering([C.OrderBy("order.metadata.creation_timestamp", "DESC")], ORDER) + [F.col("uid")]
    return _shown(C.page(C.live(objects(spark, sf_dir)), order, 100))


@query("criteria_like_wildcards", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%A_O%' OR p_name LIKE '%re%e%'")
def criteria_like_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((Criterion("part.spec.type", C.LIKE, "A_O"), Criterion("part.spec.name", C.LIKE, "re%e")), C.OR)
    return C.filter_objects(table(spark, sf_dir, "part"), tree, PART).select("p_partkey", "p_name", "p_type")


@query("criteria_in_not_in", _sql("SELECT uid, namespace, name, state, price FROM o WHERE state IN ('F', 'O') AND priority NOT IN ('1-URGENT', '5-LOW')"))
def criteria_in_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((Criterion("order.spec.status", C.IN, "[F, O ]"), Criterion("order.spec.priority", C.NOT_IN, "(1-URGENT,5-LOW)")))
    return _shown(C.filter_objects(objects(spark, sf_dir), tree, ORDER))


@query("criteria_null", _sql("SELECT uid, namespace, name, state, price FROM o WHERE state IS NULL OR (state IS NOT NULL AND price < 1000)"))
def criteria_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = Operation((Criterion("order.spec.status", C.IS_NOT_NULL), Criterion("order.spec.price", C.LT, "1000")))
    return _shown(C.filter_objects(objects(spark, sf_dir), Operation((Criterion("order.spec.status", C.IS_NULL),), C.OR, (inner,)), ORDER))


@query("criteria_bounds", _sql("SELECT uid, namespace, name, state, price FROM o WHERE price > 1500 AND price <= 90000.5 AND owner <> 7 AND state >= 'F'"))
def criteria_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((
        Criterion("order.spec.price", C.GT, "1500"), Criterion("order.spec.price", C.LTE, "90000.5"),
        Criterion("order.spec.owner", C.NOT_EQUAL, "7"), Criterion("order.spec.status", C.GTE, "F"),
    ))
    return _shown(C.filter_objects(objects(spark, sf_dir), tree, ORDER))


@query("label_semi", _sql("SELECT uid, namespace, name, state, price FROM o WHERE price > 100000 AND uid IN (SELECT obj_uid FROM l WHERE key = 'priority' AND value LIKE '%U%')"))
def label_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((Criterion("order.spec.price", C.GT, "100000"), Criterion("priority", C.LIKE, "U", label=True)))
    return _shown(C.filter_objects(objects(spark, sf_dir), tree, ORDER, labels(spark, sf_dir)))


@query("label_inner_multi", _sql("""SELECT uid, namespace, name, state, price FROM o
WHERE uid IN (SELECT obj_uid FROM l WHERE key = 'status' AND value = 'O') AND uid IN (SELECT obj_uid FROM l WHERE key = 'priority' AND value IN ('1-URGENT', '2-HIGH'))"""))  # fmt: skip
def label_inner_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(selectors.select_by_labels(objects(spark, sf_dir), labels(spark, sf_dir), "status==O,priority in (1-URGENT, 2-HIGH)"))


@query("label_anti_missing", _sql("SELECT uid, namespace, name, state, price FROM o WHERE uid NOT IN (SELECT obj_uid FROM l WHERE key = 'priority')"))
def label_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(selectors.select_by_labels(objects(spark, sf_dir), labels(spark, sf_dir), "!priority"))


@query("label_anti_notin", _sql("SELECT uid, namespace, name, state, price FROM o WHERE uid NOT IN (SELECT obj_uid FROM l WHERE key = 'priority' AND value IN ('1-URGENT', '5-LOW'))"))
def label_anti_notin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(selectors.select_by_labels(objects(spark, sf_dir), labels(spark, sf_dir), "priority notin (1-URGENT,5-LOW)"))


@query("label_or_field", _sql("SELECT uid, namespace, name, state, price FROM o WHERE price < 2000 OR uid IN (SELECT obj_uid FROM l WHERE key = 'priority' AND value = '3-MEDIUM')"))
def label_or_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Operation((Criterion("order.spec.price", C.LT, "2000"), Criterion("priority", C.EQUAL, "3-MEDIUM", label=True)), C.OR)
    return _shown(C.filter_objects(objects(spark, sf_dir), tree, ORDER, labels(spark, sf_dir)))


@query("field_selector_empty", _sql("SELECT uid, namespace, name, state, price FROM o WHERE (state IS NULL OR state = '') AND priority IN ('1-URGENT', '2-HIGH')"))
def field_selector_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selectors.list_objects(objects(spark, sf_dir), ORDER, labels(spark, sf_dir), field_selector="order.spec.status=,order.spec.priority in (1-URGENT,2-HIGH)")
    return _shown(found)


@query("order_by_label", _sql("SELECT uid, name, value AS label_value FROM o JOIN l ON uid = obj_uid AND key = 'priority' ORDER BY value DESC, uid LIMIT 50"))
def order_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, order = C.order_by_label(objects(spark, sf_dir), labels(spark, sf_dir), "priority", ORDER, inner=True)
    return C.page(met, [order, F.col("uid")], 50).select("uid", "name", "label_value")


@query("page_offset", _sql("SELECT uid, namespace, name, state, price FROM o ORDER BY state ASC NULLS FIRST, price DESC NULLS LAST, uid LIMIT 25 OFFSET 50"))
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = C.ordering([C.OrderBy("order.spec.status", "asc"), C.OrderBy("order.spec.price", "desc")], ORDER) + [F.col("uid")]
    return _shown(C.page(objects(spark, sf_dir), order, 25, "50"))


@query("latest_n", _sql("SELECT uid, name, create_time FROM o ORDER BY create_time DESC NULLS LAST, uid LIMIT 10"))
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(objects(spark, sf_dir), 10).select("uid", "name", "create_time")


@query("case_insensitive_equal", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def case_insensitive_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = C.case_insensitive(F.col("c_mktsegment")) == F.lit("bUiLdInG")
    return table(spark, sf_dir, "customer").where(hit).select("c_custkey", "c_mktsegment")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of objects keyed by user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("create_time"), F.col("event_type").alias("state"), F.col("value"),
        F.lit(None).cast("timestamp_ntz").alias("delete_time"),
    )


@query("upsert_latest", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k,
  first_value(ts) OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS create_time FROM events)
SELECT user_id AS key, event_id AS seq, create_time, event_type AS state, value FROM e WHERE k = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    old, new = c.where("seq % 2 = 0"), c.where("seq % 2 = 1")
    snapshot = ingest.upsert(old.limit(0), old)
    return ingest.upsert(snapshot, new).select("key", "seq", "create_time", "state", "value")


@query("soft_delete_scan", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS key, event_type AS state FROM e WHERE k = 1 AND user_id % 3 <> 0""")
def soft_delete_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = ingest.latest_changes(changes(spark, sf_dir))
    gone = snapshot.where(F.pmod("key", F.lit(3)) == 0)
    after = ingest.soft_delete(snapshot, gone, F.lit("2024-06-01").cast("timestamp_ntz"))
    return after.where(F.col("delete_time").isNull()).select("key", "state")


@query("change_operations", """SELECT CASE WHEN event_id % 11 = 0 THEN 'ignore' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'wait' WHEN event_id % 7 = 0 THEN 'retain'
  WHEN event_id % 5 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'archive' ELSE 'upsert' END AS op, count(*) AS n FROM events GROUP BY 1""")
def change_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    op = ingest.operation(i % 11 != 0, F.when(i % 7 == 0, F.col("ts")), F.when(i % 2 == 0, 2).otherwise(1), i % 5 == 0, i % 3 == 0)
    return table(spark, sf_dir, "events").groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS key, event_id AS seq, event_type AS state, value FROM e WHERE k = 1""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans.scratch import scratch

    path, state = scratch(spark, "ingest"), scratch(spark, "ingest-state")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    renamed = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.col("value"))
    q = ingest.ingest_stream(renamed, path, state)
    q.awaitTermination()
    return ingest.read_snapshot(spark, path, int(q.lastProgress["batchId"])) if q.lastProgress else renamed.limit(0)


@query("stream_day_counts", """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events, m
GROUP BY 1, 2, w HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= w""")
def stream_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans.scratch import scratch

    path, state = scratch(spark, "day-counts"), scratch(spark, "day-counts-state")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    counts = ingest.window_counts(stream, "ts", ["event_type"], "1 day", "10 minutes")
    counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n bigint").parquet(path)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
