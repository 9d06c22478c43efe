"""Queries over transforms, windowed features, point-in-time joins and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, text, transforms
from millrace.operators import features as W
from millrace.operators import prep, vector
from millrace.plans import registry
from millrace.plans.registry import query, table

_KEY = "l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _keyed(df: DataFrame, *columns) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *columns)


@query("t_divide", f"""SELECT {_KEY}, CASE WHEN n = 0 AND d = 0 THEN 0.0 ELSE n / CASE WHEN d = 0 THEN 1e-7 ELSE d END END AS ratio
FROM (SELECT *, l_extendedprice AS n, CAST(l_quantity AS DOUBLE) % 5 AS d FROM lineitem)""")
def t_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), transforms.divide(F.col("l_extendedprice"), F.col("l_quantity") % 5).alias("ratio"))


@query("t_log", f"SELECT {_KEY}, round(CASE WHEN l_discount * 100 - 2 + 1 < 0 THEN CAST('NaN' AS DOUBLE) WHEN l_discount * 100 - 2 + 1 = 0 THEN 1.0 ELSE greatest(1.0, least(1e20, ln(l_discount * 100 - 2 + 1))) END, 9) AS y FROM lineitem")
def t_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), F.round(transforms.log_transform(F.col("l_discount") * 100 - 2), 9).alias("y"))


@query("t_subtract", f"SELECT {_KEY}, CAST(l_partkey AS DOUBLE) - CAST(l_suppkey AS DOUBLE) AS diff FROM lineitem")
def t_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), transforms.subtract(F.col("l_partkey"), F.col("l_suppkey")).alias("diff"))


@query("t_floor", f"SELECT {_KEY}, floor(l_extendedprice) AS y, l_linenumber AS z FROM lineitem")
def t_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), transforms.floor(F.col("l_extendedprice"), "double").alias("y"), transforms.floor(F.col("l_linenumber"), "int").alias("z"))


@query("t_ceil", f"SELECT {_KEY}, ceil(l_extendedprice * -1) AS y FROM lineitem")
def t_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), transforms.ceil(-F.col("l_extendedprice"), "double").alias("y"))


@query("t_cast", f"SELECT {_KEY}, CAST(trunc(-l_extendedprice) AS BIGINT) AS price, TRY_CAST(l_returnflag AS BIGINT) AS flag FROM lineitem")
def t_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).withColumn("minus", -F.col("l_extendedprice"))
    return _keyed(transforms.cast_columns(df, ["minus", "l_returnflag"], ["price", "flag"], strict=False), "price", "flag")


@query("t_constant", f"SELECT {_KEY}, CAST(7 AS BIGINT) AS seven FROM lineitem")
def t_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(transforms.constant(_lines(spark, sf_dir), ["l_tax"], ["seven"], 7, "bigint"), "seven")


@query("t_identity", f"SELECT {_KEY}, l_tax AS tax FROM lineitem")
def t_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(transforms.identity(_lines(spark, sf_dir), ["l_tax"], ["tax"]), "tax")


@query("t_concat", f"SELECT {_KEY}, l_quantity AS a, l_tax AS c, CAST(3 AS INT) AS n FROM lineitem")
def t_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(transforms.concatenated(_lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "v", "double"), F.col("v")[0].alias("a"), F.col("v")[2].alias("c"), F.size("v").alias("n"))


@query("t_stack", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * (CAST(embedding[i] AS DOUBLE) - 2 * CAST(embedding[65 - i] AS DOUBLE)))), 6) AS s FROM embeddings")
def t_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of a vector and its reverse, reduced to one number so that rows compare."""
    e = table(spark, sf_dir, "embeddings").withColumn("back", F.reverse("embedding"))
    m = transforms.stacked(e, ["embedding", "back"], "m")
    weighted = F.transform("m", lambda cell, i: (i + 1) * (cell[0] - 2 * cell[1]))
    return m.select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


_VOCABULARY = (5, 1, 3, 5, 12)


@query("t_vocab_index", f"SELECT {_KEY}, CASE WHEN l_suppkey = 5 THEN 0 WHEN l_suppkey = 1 THEN 1 WHEN l_suppkey = 3 THEN 2 WHEN l_suppkey = 12 THEN 4 ELSE 5 END::BIGINT AS idx FROM lineitem")
def t_vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), transforms.vocabulary_index(F.col("l_suppkey"), list(_VOCABULARY)).alias("idx"))


@query("t_vocab_join", f"WITH v AS (SELECT p_partkey AS value, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS place FROM part WHERE p_size < 20) SELECT {_KEY}, coalesce(place, 100000) AS idx FROM lineitem LEFT JOIN v ON l_partkey = value")
def t_vocab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = W.dense_index(table(spark, sf_dir, "part").where("p_size < 20"), "p_partkey", "place").withColumnRenamed("p_partkey", "value")
    return _keyed(transforms.vocabulary_join(_lines(spark, sf_dir), "l_partkey", v, "idx", 100000), "idx")


@query("pad_ragged", """WITH w AS (SELECT doc_id, string_split(left(lang, 2), '')[1:1 + CAST(doc_id % 2 AS INT)] AS a FROM documents)
SELECT doc_id, array_to_string(a, '|') || CASE WHEN len(a) < 2 THEN '|' ELSE '' END AS cells FROM w""")
def pad_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.slice(F.split("lang", ""), F.lit(1), (F.col("doc_id") % 2 + 1).cast("int"))
    df = table(spark, sf_dir, "documents").select("doc_id", letters.alias("a"))
    return arrays.padded(df, "a", "b").select("doc_id", F.array_join("b", "|").alias("cells"))


@query("parse_array_string", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 4) AS ends, CAST(64 AS INT) AS n FROM embeddings")
def parse_array_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("s"))
    a = e.select("vec_id", arrays.parse_array(F.col("s")).alias("a"))
    return a.select("vec_id", F.round(F.element_at("a", 1).cast("double") + F.element_at("a", -1).cast("double"), 4).alias("ends"), F.size("a").alias("n"))


@query("fixed_width_set", "SELECT p_partkey, array_to_string((string_split(p_type, ' ') || ['', '', '', ''])[1:2], '|') AS w FROM part")
def fixed_width_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(arrays.fixed_width(F.split("p_type", " "), 2, F.lit("")), "|").alias("w"))


@query("l2_normalise", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS head FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(arrays.l2_normalised(F.col("embedding"))[0], 6).alias("head"))


#: CamelCase names and what they become, as stated by the semantics; fixed values.
NAMES = {
    "CamelCase": "camel_case", "SimpleCase": "simple_case", "Word": "word", "word": "word", "snake_case": "snake_case", "XMLHttpRequest": "xml_http_request",
    "HTTPResponse": "http_response", "CamelCase2Text": "camel_case2text", "Test123Case": "test123_case", "parseHTML5Content": "parse_htm_l5content",
    "_PrivateClass": "private__private_class", "_privateMethod": "private_private_method", "A": "a", "a": "a",
}


@query("text_functions", f"""SELECT p_partkey, (ARRAY{list(NAMES.values())})[p_partkey % {len(NAMES)} + 1] AS snake,
  regexp_replace(p_type || '!?*', '[^a-zA-Z0-9\\-_. ,]', '', 'g') AS clean,
  CASE WHEN length(repeat(p_name, 6)) > 60 THEN left(sha256(repeat(p_name, 6)), 8) || '-' || right(repeat(p_name, 6), 51) ELSE repeat(p_name, 6) END AS short FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_name = F.repeat("p_name", 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.snake_case(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))).alias("snake"),
        text.whitelisted(F.concat("p_type", F.lit("!?*"))).alias("clean"), text.short_label(long_name).alias("short"),
    )


@query("time_functions", "SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts - INTERVAL 3 DAY, '%Y-%m-%d') AS earlier FROM events")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", text.epoch_millis(ts).alias("millis"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"), text.date_string(-3, ts).alias("earlier")
    )


@query("prompt_template", """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '### Instruction:' || chr(10) || lang || chr(10) || chr(10) || '### Response:' || chr(10) || source
  ELSE '### Instruction:' || chr(10) || lang || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) || source END) AS h FROM documents""")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("doc_id") % 2 == 1, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.prompt(F.col("lang"), context, F.col("source"))).alias("h"))


#: Added before rounding, so that no exact decimal tie is rounded by the last bit of a sum.
_OFF_TIES = 1.23e-7


def _windows(spark: SparkSession, sf_dir: str, op: str, *days: int) -> DataFrame:
    a = W.Aggregation("value", op, tuple(W.TimeWindow(d) for d in days))
    out = W.trailing_windows(table(spark, sf_dir, "events"), ["user_id"], text.epoch_micros(F.col("ts")), [a])
    names = [W.feature_name(a, w) for w in a.windows]
    return out.select("event_id", *[F.round(F.col(n) + _OFF_TIES, 6).alias(n) if op in ("sum", "average", "variance") else n for n in names])


def _window_sql(op: str, expr: str, *days: int) -> str:
    frame = "over (PARTITION BY user_id ORDER BY us RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    cols = ", ".join(expr.format(over=frame.format(w=d * 86_400_000_000)) + f" AS {op}_value_{d}days" for d in days)
    return f"SELECT event_id, {cols} FROM (SELECT *, epoch_us(ts) AS us FROM events)"


@query("win_count", _window_sql("count", "count(value) {over}", 1, 7, 30))
def win_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "count", 1, 7, 30)


@query("win_avg", _window_sql("average", "round(avg(value) {over} + 1.23e-7, 6)", 3, 14))
def win_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "average", 3, 14)


@query("win_sum", _window_sql("sum", "round(sum(value) {over} + 1.23e-7, 6)", 1, 7))
def win_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "sum", 1, 7)


@query("win_var", _window_sql("variance", "round(var_pop(value) {over} + 1.23e-7, 6)", 7))
def win_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "variance", 7)


@query("win_minmax", _window_sql("min", "min(value) {over}", 7).replace(" FROM (", ", max(value) over (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS max_value_7days FROM (", 1))
def win_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = (W.TimeWindow(7),)
    out = W.trailing_windows(table(spark, sf_dir, "events"), ["user_id"], text.epoch_micros(F.col("ts")), [W.Aggregation("value", "min", week), W.Aggregation("value", "max", week)])
    return out.select("event_id", "min_value_7days", "max_value_7days")


@query("win_unique", """SELECT a.event_id, count(DISTINCT b.event_type) AS unique_count_event_type_7days FROM events a LEFT JOIN events b
ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 7 DAY GROUP BY a.event_id""")
def win_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = W.Aggregation("event_type", "unique_count", (W.TimeWindow(7),))
    out = W.trailing_windows(table(spark, sf_dir, "events"), ["user_id"], text.epoch_micros(F.col("ts")), [a])
    return out.select("event_id", "unique_count_event_type_7days")


@query("pit_join_multi", """SELECT a.event_id, count(b.value) AS click_count_value_7days, round(avg(b.value) + 1.23e-7, 6) AS click_average_value_7days
FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b
ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 7 DAY GROUP BY a.event_id""")
def pit_join_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", text.epoch_micros(F.col("ts")))
    source = W.EventSource(e.where("event_type = 'click'"), {"user_id": "user_id", "value": "value"}, "us")
    week = (W.TimeWindow(7),)
    part = W.GroupBy(source, ("user_id",), (W.Aggregation("value", "count", week), W.Aggregation("value", "average", week)))
    out = W.point_in_time(e.where("event_type = 'purchase'"), "us", [("click", part)])
    return out.select("event_id", "click_count_value_7days", F.round(F.col("click_average_value_7days") + _OFF_TIES, 6).alias("click_average_value_7days"))


@query("pit_join_two_parts", """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.event_id, (SELECT count(c.value) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts AND c.ts >= p.ts - INTERVAL 3 DAY) AS click_count_value_3days,
  (SELECT max(v.value) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 14 DAY) AS view_max_value_14days FROM p""")
def pit_join_two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", text.epoch_micros(F.col("ts")))
    part = lambda kind, op, days: W.GroupBy(W.EventSource(e.where(F.col("event_type") == kind), {"user_id": "user_id", "value": "value"}, "us"), ("user_id",), (W.Aggregation("value", op, (W.TimeWindow(days),)),))
    out = W.point_in_time(e.where("event_type = 'purchase'"), "us", [("click", part("click", "count", 3)), ("view", part("view", "max", 14))])
    return out.select("event_id", "click_count_value_3days", "view_max_value_14days")


@query("untimed_features", """SELECT user_id, event_type, count(value) AS count_value, round(avg(value) + 1.23e-7, 6) AS average_value, max(value) AS max_value, min(value) AS min_value,
  count(DISTINCT props) AS unique_count_props FROM events GROUP BY 1, 2""")
def untimed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [W.Aggregation("value", o) for o in ("count", "average", "max", "min")] + [W.Aggregation("props", "unique_count")]
    return W.untimed(table(spark, sf_dir, "events"), ["user_id", "event_type"], ops).withColumn("average_value", F.round(F.col("average_value") + _OFF_TIES, 6))


@query("popularity_tier", "SELECT user_id, n, CASE WHEN n >= 90 THEN 'popular' WHEN n >= 60 THEN 'moderate' ELSE 'niche' END AS tier FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def popularity_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("tier", prep.tiered(F.col("n"), [(90, "popular"), (60, "moderate")], "niche"))


@query("dense_index", "SELECT DISTINCT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS user_idx FROM orders")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dense_index(table(spark, sf_dir, "orders"), "o_custkey", "user_idx")


@query("rating_norm", f"SELECT {_KEY}, (l_linenumber - 1) / 4.0 AS r FROM lineitem")
def rating_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_lines(spark, sf_dir), prep.rating_norm(F.col("l_linenumber").cast("double")).alias("r"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, with filter values around its own id."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.array("label").alias("labels"),
        (F.col("vec_id") - 500).alias("lo"), (F.col("vec_id") + 1500).alias("hi"), (F.col("vec_id") % 4).alias("member"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), "embedding", "label", F.col("vec_id").alias("number"), F.array(F.col("vec_id") % 4, F.col("vec_id") % 3).alias("members"))


_FILTERS = vector.Filters({"label": "labels"}, {"members": "member"}, {"number": "lo"}, {"number": "hi"})
_VECTOR_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql, vec_id - 500 AS lo, vec_id + 1500 AS hi, vec_id % 4 AS member FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS item_id, list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS dot,
  list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS qq, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS ee,
  (CASE WHEN label = ql THEN 1 ELSE 0 END) - 1 + (CASE WHEN vec_id % 4 = member THEN 1 ELSE 0 END) + (CASE WHEN vec_id % 3 = member THEN 1 ELSE 0 END) - 1
  + (CASE WHEN vec_id >= lo THEN 0 ELSE -1 END) + (CASE WHEN vec_id <= hi THEN 0 ELSE -1 END) AS soft, label, ql FROM q, embeddings) """


def _rank_sql(score: str, k: int, source: str = "s") -> str:
    return f"""SELECT query_id, item_id, round(score, 6) + 0.0 AS score, CAST(rank AS INT) AS rank FROM (
SELECT query_id, item_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, item_id) AS rank FROM {source}) WHERE rank <= {k}"""


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("vec_topk", _VECTOR_SQL + _rank_sql("dot", 10))
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vector.search(_queries(spark, sf_dir), _items(spark, sf_dir), "query_id", "item_id", 10))


@query("vec_topk_filtered", _VECTOR_SQL + _rank_sql("dot + soft", 5))
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vector.search(_queries(spark, sf_dir), _items(spark, sf_dir), "query_id", "item_id", 5, _FILTERS))


@query("vec_two_stage", _VECTOR_SQL + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY soft DESC, item_id) AS m FROM s), g AS (SELECT * FROM f WHERE m <= 50) " + _rank_sql("dot + soft", 10, "g"))
def vec_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vector.search(_queries(spark, sf_dir), _items(spark, sf_dir), "query_id", "item_id", 10, _FILTERS, 50))


@query("vec_euclid", _VECTOR_SQL + _rank_sql("-sqrt(greatest(qq + ee - 2 * dot, 1e-6))", 5))
def vec_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vector.search(_queries(spark, sf_dir), _items(spark, sf_dir), "query_id", "item_id", 5, relevance=vector.negative_distance))


@query("hit_rate_at_k", _VECTOR_SQL + """, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, item_id) AS rank FROM s)
SELECT round(avg(CASE WHEN h.query_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate FROM q LEFT JOIN (SELECT DISTINCT query_id FROM r WHERE rank <= 3 AND item_id = query_id) h USING (query_id)""")
def hit_rate_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir)
    found = vector.search(q, _items(spark, sf_dir), "query_id", "item_id", 3)
    return vector.hit_rate(found, q.select("query_id", F.col("query_id").alias("item_id")), "query_id", "item_id", 3).select(F.round("hit_rate", 6).alias("hit_rate"))


# The names under which the searches over all ids divisible by 50 were first registered.
for _name in ("vec_topk", "vec_topk_filtered", "vec_two_stage", "vec_euclid", "hit_rate_at_k"):
    registry.QUERIES[f"{_name}_whole"], registry.ORACLES[f"{_name}_whole"] = registry.QUERIES[_name], registry.ORACLES[_name]


@query("log_q_correction", "SELECT label, round(ln(1 - pow(1 - p, 64)), 6) AS c FROM (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label)")
def log_q_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    share = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("t"))))
    return share.select("label", F.round(vector.log_q_correction(F.col("n") / F.col("t"), 64), 6).alias("c"))
