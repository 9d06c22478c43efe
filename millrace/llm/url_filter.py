"""URL rules by a sort-merge range join over reversed-host keys.

A host's key is its labels in reverse order, each followed by a dot (``www.example.net`` gives
``net.example.www.``), so a rule for a host and all its subdomains covers the keys that its own key begins. As bytes these
are the interval from the key to the key with 0xFF behind it, a byte that no UTF-8 text holds: intervals are
nested or disjoint. A rule's paths are intervals in the same way, of keys of host and path.

The sweep sorts interval starts, interval ends and points together. A start pushes its rule and an end pops it: the running
sum of both is the depth of the stack, and the entry at one depth is the last rule that started at that depth. Range
partitions are swept at once; sums and last starts of the partitions before it tell each one the stack it begins with.
Two sweeps give the rules of a URL: one over distinct hosts finds the stack of rule hosts, one over
(rule host, path) finds the innermost path rule of each of them, so neither rules of one host nor
stacks are copied into page rows.

Of the rules that fit, the longest (host and path) wins; equal lengths are decided by code point. Of repeated
rules with different verdicts block wins.

Native: DataFrame functions only. A null URL or one without ``://`` has an empty host and path and gets the
default verdict, as do hosts without a rule. Rules with an empty host cover nothing; null paths of rules are
empty. Repeated rows and null page_ids are judged alike, URLs of any length are taken whole, extra columns of any name
are left out; an empty table gives no rows, an empty rule table the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, lookup_join, ordered, partition_offsets


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _place_key(host: Column, path: Column) -> Column:
    """Host key and path as bytes; 0x00, which ends the host, sorts before all that a longer host could hold."""
    return F.concat(host_key(host).cast("binary"), F.unhex(F.lit("00")), path.cast("binary"))


def open_intervals(points: DataFrame, intervals: DataFrame, innermost: bool = False) -> DataFrame:
    """point and rule for each interval on the stack at a point, or for the innermost one only.

    ``points``: key (binary), point. ``intervals``: key, rule; an interval covers the keys that its key begins. Keys of each
    are distinct.
    """
    end = F.concat("key", F.unhex(F.lit("FF")))
    point_type, rule_type = points.schema["point"].dataType, intervals.schema["rule"].dataType
    no_point, no_rule = F.lit(None).cast(point_type).alias("point"), F.lit(None).cast(rule_type).alias("rule")
    line = intervals.select("key", F.lit(0).alias("rank"), F.lit(1).alias("push"), "rule", no_point)
    line = line.unionByName(intervals.select(end.alias("key"), F.lit(0).alias("rank"), F.lit(-1).alias("push"), no_rule, no_point))
    line = line.unionByName(points.select("key", F.lit(1).alias("rank"), F.lit(0).alias("push"), no_rule, "point"))
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = ordered(line, ["key", "rank"], parts)
    before = F.broadcast(partition_offsets(line, before=F.col("push")))  # one row per partition
    sweep = Window.partitionBy("pid_").orderBy("key", "rank").rowsBetween(Window.unboundedPreceding, 0)
    depth = (F.col("before") + F.sum("push").over(sweep)).alias("depth")
    stacked = line.join(before, "pid_").select("pid_", "key", "rank", "push", "rule", "point", depth).where("push >= 0")
    # a start stands at its own depth, a point at all depths of the stack or at its top
    down = F.array("depth") if innermost else F.sequence(F.lit(1).cast("long"), "depth")
    at = stacked.where((F.col("push") == 1) | (F.col("depth") > 0))
    at = at.withColumn("level", F.explode(F.when(F.col("push") == 1, F.array("depth")).otherwise(down)))
    ends = at.where("push = 1").groupBy("pid_", "level").agg(F.max_by("rule", "key").alias("rule"))
    earlier = Window.partitionBy("level").orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)
    spread = at.select("pid_", "level").distinct().join(ends, ["pid_", "level"], "left")  # partitions times depth
    carried = spread.select("pid_", "level", F.last("rule", True).over(earlier).alias("carried"))
    same = Window.partitionBy("pid_", "level").orderBy("key", "rank").rowsBetween(Window.unboundedPreceding, 0)
    last = at.withColumn("rule", F.last("rule", True).over(same)).where("rank = 1").join(carried, ["pid_", "level"])
    return last.select("point", F.coalesce("rule", "carried").alias("rule"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null), verdict.

    ``rules``: host, path, verdict (``block`` or ``allow``).
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = checkpoint(urls.select("page_id", F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).alias("place")))
    own = rules.select(_lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    own = checkpoint(own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # block sorts after allow
    rule_hosts = own.select("host").distinct().select(host_key(F.col("host")).cast("binary").alias("key"), F.col("host").alias("rule"))
    places = urls.select("place").distinct().select("place", F.col("place.host").alias("host"))
    hosts = places.select("host").distinct().select(host_key(F.col("host")).cast("binary").alias("key"), F.col("host").alias("point"))
    # a host has at most as many rule hosts above it as labels
    stacks = open_intervals(hosts, rule_hosts).groupBy(F.col("point").alias("host")).agg(F.collect_set("rule").alias("over"))
    met = lookup_join(places, stacks, "host").select("place", F.explode("over").alias("over"))
    sought = met.groupBy("over", F.col("place.path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    sought = sought.select(_place_key(F.col("over"), F.col("path")).alias("key"), F.struct("over", "path").alias("point"))
    paths = own.select(_place_key(F.col("host"), F.col("path")).alias("key"), F.struct("host", "path", "verdict").alias("rule"))
    fits = open_intervals(sought, paths, innermost=True)
    met = lookup_join(met.select("place", F.struct("over", F.col("place.path").alias("path")).alias("point")), fits, "point")
    rank = F.struct((F.length("rule.host") + F.length("rule.path")).alias("n"), F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict"))
    best = met.groupBy("place").agg(F.max(rank).alias("best"))
    out = lookup_join(urls, best, "place", "left")
    return out.select("page_id", "place.host", "place.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
