"""The query of each training-data operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, remove, scratch
from millrace.llm import chat, decontaminate, licenses, minhash, mixing, shards, stream_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Words of a lower-cased text and its distinct runs of five, for the SQL twins.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w
), m AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT doc_id AS id, doc_id AS seen FROM s UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a
), c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.id = s.doc_id
"""


@_query("op1_minhash_near_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op2_pivotal_mix")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"), weights=[3, 1, 2], factor=1.5, cap=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


_OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""


@_query("op3_warc_normaliser", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono, normal = scratch(spark, "warc-mono"), scratch(spark, "warc")
    warc.write_monolithic(warc.records(_table(spark, sf_dir, "pages")), mono)
    warc.normalise(spark, mono, normal)
    back = warc.read_records(warc.read_index(spark, normal))
    page = lambda c: F.regexp_extract(c, "urn:x-page:(-?[0-9]+)", 1).cast("long")
    out = back.select(
        page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"),
    )
    out = checkpoint(out)
    remove(spark, mono, normal)  # the archives have been read back
    return out


@_query("op4_prefix_sum_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.byte_balanced(_table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_OP5_SQL = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""


@_query("op5_stream_exact_dedup", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


@_query("op6_string_tiling_leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op7_license_signatures")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents")).drop("detections")


@_query("op8_toxicity_lexicon")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scores.select(
        "doc_id", (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


_OP9_ESC = "replace(replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '<', '<\\'), '[', '[\\'), '|', '|\\')"
_OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(10 + length({_OP9_ESC.format(c="role")}) + length({_OP9_ESC.format(c="text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@_query("op9_chat_events", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(chat.logged_events(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The rules of the contract: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_OP10_SQL = """
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@_query("op10_url_rules", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))
