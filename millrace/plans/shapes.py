"""Queries over nested cells, literals, pooling, validation rules and the rest of readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, text, transforms
from millrace.operators import console, prep
from millrace.operators import criteria as C
from millrace.operators.criteria import Criterion, Operation
from millrace.operators.selectors import list_objects
from millrace.plans.objects import ORDER, _shown, _sql, labels, objects
from millrace.plans.registry import query, table
from millrace.plans.scratch import scratch
from millrace.sources import readers, sinks
from millrace.streaming import ingest


@query("pad_levels", """WITH w AS (SELECT p_partkey, [string_split(p_name, ' '), string_split(p_type, ' ')] AS ws FROM part),
m AS (SELECT max(greatest(len(ws[1]), len(ws[2]))) AS n, max(list_max(list_transform(ws[1] || ws[2], lambda x: length(x)))) AS k FROM w)
SELECT p_partkey, array_to_string(list_transform(range(1, n + 1), lambda i: rpad(coalesce(ws[1][i], ''), CAST(k AS INT), '_')) || list_transform(range(1, n + 1), lambda i: rpad(coalesce(ws[2][i], ''), CAST(k AS INT), '_')), '|') AS cells FROM w, m""")
def pad_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of words of two texts: three ragged levels, two of them filled."""
    letters = lambda c: F.transform(F.split(c, " "), lambda w: F.split(w, ""))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(letters("p_name"), letters("p_type")).alias("a"))
    words = F.flatten(F.col("b"))
    return arrays.padded(p, "a", "b", "_").select("p_partkey", F.array_join(F.transform(words, lambda w: F.array_join(w, "")), "|").alias("cells"))


@query("parse_literals", "SELECT vec_id, vec_id AS a, CAST(label AS BIGINT) AS c, CAST(3 AS INT) AS n, vec_id % 2 = 0 AS even FROM embeddings")
def parse_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples with None and a comma at the end, and lists of truth values."""
    e = table(spark, sf_dir, "embeddings")
    numbers = F.concat(F.lit("("), F.col("vec_id").cast("string"), F.lit(", None, "), F.col("label").cast("string"), F.lit(",)"))
    truths = F.concat(F.lit("["), F.when(F.col("vec_id") % 2 == 0, "True").otherwise("False"), F.lit("]"))
    read = e.select("vec_id", arrays.parse_array(numbers, "array<bigint>").alias("x"), arrays.parse_array(truths, "array<boolean>").alias("y"))
    return read.where(F.get("x", F.lit(1)).isNull()).select("vec_id", F.col("x")[0].alias("a"), F.col("x")[2].alias("c"), F.size("x").alias("n"), F.col("y")[0].alias("even"))


@query("mean_pooling", """SELECT vec_id, round(list_avg(list_transform(list_filter(range(0, 16), lambda i: (vec_id + i) % 3 <> 0), lambda i: CAST(embedding[4 * i + 1] AS DOUBLE))) + 1.23e-9, 6) AS masked,
  round(list_avg(list_transform(range(0, 16), lambda i: CAST(embedding[4 * i + 4] AS DOUBLE))) + 1.23e-9, 6) AS plain FROM embeddings""")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as 16 token states of four, pooled with and without a mask."""
    places = F.sequence(F.lit(0), F.lit(15))
    tokens = F.transform(places, lambda i: F.slice("embedding", 4 * i + 1, F.lit(4)))
    mask = F.transform(places, lambda i: ((F.col("vec_id") + i) % 3 != 0).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t"), mask.alias("m"))
    one = lambda c, at: F.round(c[at] + 1.23e-9, 6)
    return e.select("vec_id", one(arrays.mean_pooled(F.col("t"), F.col("m")), 0).alias("masked"), one(arrays.mean_pooled(F.col("t")), 3).alias("plain"))


@query("accessor_paths", "SELECT o_orderkey, o_orderstatus AS state, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'none') AS second FROM orders")
def accessor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by path through structs and arrays, the default where an array is too short."""
    item = lambda c: F.struct(F.col(c).alias("name"))
    parts = F.when(F.col("o_orderkey") % 2 == 0, F.array(item("o_orderstatus"), item("o_orderpriority"))).otherwise(F.array(item("o_orderstatus")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(parts.alias("items")).alias("spec"))
    return o.select("o_orderkey", console.accessor("spec.items[0].name").alias("state"), console.accessor("spec.items[1].name", "none").alias("second"))


@query("vocab_arrays", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE l_linenumber WHEN 4 THEN 0 WHEN 2 THEN 1 ELSE 2 END, CASE l_linenumber + 1 WHEN 4 THEN 0 WHEN 2 THEN 1 ELSE 2 END) AS places, 'array<int>' AS kind FROM lineitem")
def vocab_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber").cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(line, line + 1).alias("a"))
    out = transforms.vocabulary_indexed(rows, ["a"], ["i"], [4, 2])
    return out.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.col("i").cast("array<string>")).alias("places"), F.typeof("i").alias("kind"))


@query("length_band_words", "SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents) WHERE n BETWEEN 20 AND 400")
def length_band_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n"))
    return prep.length_band(docs, F.col("n"), 20, 400)


@query("staging_left_join_all", """SELECT l_orderkey, l_linenumber, p_name AS title, CAST(l_quantity AS DOUBLE) AS score, epoch_us(date_trunc('day', l_shipdate)) // 1000 AS ts
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_name IS NOT NULL AND l_quantity IS NOT NULL""")
def staging_left_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    met = met.where("p_name is not null and l_quantity is not null")
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    return met.select("l_orderkey", "l_linenumber", F.col("p_name").alias("title"), F.col("l_quantity").cast("double").alias("score"), text.epoch_millis(day).alias("ts"))


@query("safe_texts", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS plain, '[' || o_orderkey || ',' || o_custkey || ']' AS nested FROM orders")
def safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.safe_text(some).alias("plain"), text.safe_text(F.array("o_orderkey", "o_custkey"), True).alias("nested"))


@query("stable_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE 'u' || user_id END AS key FROM events")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation where there is one; null and empty ones fall back on the uid."""
    i = F.col("event_id")
    annotation = F.when(i % 3 == 0, F.concat(F.lit("e"), i.cast("string"))).when(i % 3 == 1, F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", ingest.stable_key(annotation, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("key"))


@query("operation_before_selectors", _sql("SELECT uid, namespace, name, state, price FROM o WHERE delete_time IS NULL AND state = 'P'"))
def operation_before_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an operation tree the selector strings are ignored."""
    tree = Operation((Criterion("order.spec.status", C.EQUAL, "P"),))
    return _shown(list_objects(C.live(objects(spark, sf_dir)), ORDER, labels(spark, sf_dir), tree, "priority=2-HIGH", "name=none"))


_NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("read_items", _NATION_SQL)
def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "items")
    sinks.ParquetSink(path).write(table(spark, sf_dir, "nation"))
    return readers.read_items(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("read_tsv", _NATION_SQL)
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("sep", "\t").csv(path)
    return readers.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


#: Texts by kind of rule, and whether they are right; each nation's key picks one.
CASES = {
    "email": (("a@b.org", True), ("a.b", False), ("a b@c.org", False)),
    "uri": (("https://example.org/x", True), ("example", False), ("mailto:a@b.org", True)),
    "ipv4": (("10.0.0.255", True), ("10.0.0.256", False), ("10.0.0", False)),
    "ipv6": (("fe80::1", True), ("1::2::3", False), ("1:2:3:4:5:6:7:8", True)),
    "uuid": (("123e4567-e89b-12d3-a456-426614174000", True), ("123e4567", False), ("123E4567-E89B-12D3-A456-42661417400Z", False)),
    "hostname": (("www.example.org", True), ("-a.org", False), ("a..b", False)),
    "host_address": (("10.0.0.1", True), ("example.org", True), ("a b", False)),
}
_BAD = " UNION ALL ".join(
    f"""SELECT '{rule}_' AS "column", '{rule}' AS rule, count(*) FILTER (WHERE c_custkey % 3 IN ({', '.join(str(i) for i, (_, ok) in enumerate(cases) if not ok)})) AS violations FROM customer"""
    for rule, cases in CASES.items()
)


@query("validate_formats", _BAD + """ UNION ALL SELECT 'words_', 'min_items', count(*) FILTER (WHERE c_custkey % 3 = 0) FROM customer
UNION ALL SELECT 'words_', 'unique_items', count(*) FILTER (WHERE c_custkey % 3 = 1) FROM customer
UNION ALL SELECT 'words_', 'each', count(*) FILTER (WHERE c_custkey % 3 = 2) FROM customer
UNION ALL SELECT 'c_nationkey', 'exclusive_min', count(*) FILTER (WHERE c_nationkey <= 3) FROM customer
UNION ALL SELECT 'c_nationkey', 'not_in', count(*) FILTER (WHERE c_nationkey IN (5, 6)) FROM customer""")
def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and array rules, each over right and wrong cells."""
    turn = F.col("c_custkey") % 3
    pick = lambda cases: F.when(turn == 0, cases[0]).when(turn == 1, cases[1]).otherwise(cases[2])
    words = pick([F.array(F.lit("a")), F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("long"))])
    c = table(spark, sf_dir, "customer").select("c_nationkey", *[pick([F.lit(v) for v, _ in cases]).alias(f"{rule}_") for rule, cases in CASES.items()], words.alias("words_"))
    rules = {f"{rule}_": {rule: None} for rule in CASES}
    rules |= {"words_": {"min_items": 2, "unique_items": None, "each": {"max_length": 2}}, "c_nationkey": {"exclusive_min": 3, "not_in": (5, 6)}}
    return prep.violations(c, rules)
