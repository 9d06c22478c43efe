"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of ``factor`` times all words, stopped at ``cap`` times its
own words; what is cut off is reshared by weight until no target is above its cap. A document of a
source is taken ``floor(rate)`` times plus once more with the rate's fractional probability, where
rate = target / source size.

The fractional copies of a source are rounded together: two documents meet, and word mass moves from
one to the other, in a random direction that keeps both expectations, until one of the two
probabilities is 0 or 1. The one left fractional meets the next document. Documents are dealt
over bounded blocks of a source; the one residual of each block goes to the next level, FAN_IN blocks
to one, until each source has one residual, which is drawn by its probability. So a source's taken
words miss its target by less than one document.

All draws come from a hash of the seed and the documents met. Documents alike in doc_id, source and
size are interchangeable: they are counted, then numbered, and blocks are dealt by a hash of all of this, so a null or
repeated doc_id spreads over blocks like others and reruns agree whatever the partitioning. Null text has
size 0 (taken 0); a null source is a source of its own, ranked last; repeated rows and null ids are documents of
their own. Extra columns of any name are kept by ``taken_rows``; texts are counted whole whatever their length.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, lookup_join, ordered, partition_offsets

#: Documents of all sources that share a block number, about. A block of one source is one group of a task.
BLOCK_ROWS = 2_000
#: Alike documents that one row stands for while they are numbered.
NUMBERED = 100_000
#: Blocks whose residuals meet on the next level of the tree.
FAN_IN = 64

_MASK = (1 << 64) - 1


def _draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) from the seed and two identifiers."""
    x = (seed * 0x9E3779B97F4A7C15 + (a & _MASK) * 0xBF58476D1CE4E5B9 + (b & _MASK) * 0x94D049BB133111EB) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(one: list, two: list, u: float) -> None:
    """Move mass between two fractional entries [id, size, p]: afterwards one p is 0 or 1.

    The words taken in expectation, ``size * p`` summed, and each p's expectation over ``u`` stay.
    """
    up = min((1 - one[2]) * one[1], two[2] * two[1])
    down = min(one[2] * one[1], (1 - two[2]) * two[1])
    if u * (up + down) < down:
        mass, full, empty = up, one, two
    else:
        mass, full, empty = down, two, one
    fills = (1 - full[2]) * full[1] <= empty[2] * empty[1]
    full[2], empty[2] = full[2] + mass / full[1], empty[2] - mass / empty[1]
    if fills:
        full[2] = 1.0
        empty[2] = min(max(empty[2], 0.0), 1.0)
    else:
        empty[2] = 0.0
        full[2] = min(max(full[2], 0.0), 1.0)


def _round_block(seed: int, last: bool):
    """Round the entries of one source and block; at most one stays fractional (none on the last level)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order_", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        p = table.column("p").to_pylist()
        ids, sizes = table.column("order_").to_pylist(), table.column("size").to_pylist()
        held = None
        entries = {}
        for i, x in enumerate(p):
            if not 0 < x < 1:
                continue
            entry = [ids[i], sizes[i], x]
            entries[i] = entry
            if held is None:
                held = i
                continue
            pivot(entries[held], entry, _draw(seed, entries[held][0], entry[0]))
            held = next((j for j in (held, i) if 0 < entries[j][2] < 1), None)
        if last and held is not None:
            entry = entries[held]
            entry[2] = 1.0 if _draw(seed, entry[0], -1) < entry[2] else 0.0
        out = [entries[i][2] if i in entries else x for i, x in enumerate(p)]
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out, pa.float64()))

    return run


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, from 0: running counts over range partitions."""
    rows = ordered(sources, [F.col("source").isNull(), "source"], 8).withColumn("at_", F.monotonically_increasing_id())
    before = F.broadcast(partition_offsets(rows, before=F.lit(1)))
    # inside a partition the increasing id counts from the partition's number times 2**33
    return rows.join(before, "pid_").withColumn("rank", F.col("before") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)))


def source_targets(sources: DataFrame, weights: list[float], factor: float, cap: float) -> DataFrame:
    """source, source_size, target. ``sources``: source, source_size. Scalars alone reach the driver."""
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    weight = reduce(lambda c, k: c.when(turn == k, F.lit(float(weights[k]))), range(len(weights)), F.when(F.lit(False), 0.0))
    known = checkpoint(_ranked(sources).select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most")))
    total = factor * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) >= F.col("most")
        now, capped, open_ = known.agg(
            F.coalesce(F.sum(over.cast("int")), F.lit(0)), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("w")))
        ).first()
        if now == stopped or not open_:
            break
        stopped, level = now, (total - (capped or 0.0)) / open_
    return known.select("source", "source_size", F.least(F.col("w") * F.lit(level), F.col("most")).alias("target"))


def _key(docs: DataFrame) -> list[Column]:
    """doc_id, source and size (words of the whole text) of each row."""
    text = F.col("text").cast("string")
    words = F.size(F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), "[\\x20\\x09-\\x0D]+", -1)) - 2
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size")]


def _numbered(rows: DataFrame) -> DataFrame:
    """Every row with a number from 0 among the rows alike; many alike are numbered in shares, each a row of its own."""
    counts = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / NUMBERED).cast("long")
    shares = counts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if not counts.where(F.col("n") > NUMBERED).isEmpty():
        shares = shares.repartition("doc_id", "source", "size", "share")
    first = F.col("share") * NUMBERED
    number = F.explode(F.sequence(first, F.least(first + NUMBERED, F.col("n")) - 1))
    return shares.select("doc_id", "source", "size", number.alias("number"))


def mixed(docs: DataFrame, weights: list[float] = [3, 1, 2], factor: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (of its source), copies, taken."""
    rows = checkpoint(_numbered(docs.select(*_key(docs))))
    n = rows.count()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, list(weights), factor, cap).withColumn("name", F.struct("source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(F.lit(0.0))
    rows = lookup_join(rows.withColumn("name", F.struct("source")).drop("source"), targets, "name", rows=n)
    whole = F.floor(rate).cast("long")
    blocks = max(1, -(-n // BLOCK_ROWS))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "number")
    level = rows.select(
        "doc_id", "size", "source", "source_size", "target", whole.alias("whole"), order.alias("order_"),
        F.when(F.col("size") > 0, rate - whole).otherwise(F.lit(0.0)).alias("p"), F.pmod(order, F.lit(blocks)).alias("block"),
    )
    done: list[DataFrame] = []
    while True:
        rounded = level.groupBy("source", "block").applyInArrow(_round_block(seed, blocks == 1), level.schema)
        rounded = checkpoint(rounded)
        if blocks == 1:
            done.append(rounded)
            break
        done.append(rounded.where("p = 0 or p = 1"))
        blocks = -(-blocks // FAN_IN)
        level = rounded.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    out = reduce(DataFrame.unionByName, done)
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return out.select("doc_id", "size", "source", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def taken_rows(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the rows, with all their columns, each as often as it is taken.

    Rows alike in doc_id, source and size share their copies as evenly as can be, in the order of a hash of the row.
    """
    alike = F.struct(*_key(docs))
    picks = mixed(docs, **params).groupBy(F.struct("doc_id", "source", "size").alias("alike")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    picks = checkpoint(picks)
    # the row itself is one column, so its own names can't clash
    whole = docs.select(alike.alias("alike"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if picks.where("rows > 1").isEmpty():
        met = lookup_join(whole, picks, "alike", hot=[]).withColumn("times", F.col("copies"))
    else:
        parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        keyed = whole.withColumns({"by": F.xxhash64("alike"), "hash": F.xxhash64("row"), "at": F.monotonically_increasing_id()})
        line = ordered(keyed, ["by", "hash", "at"], parts)
        # rows before a row's partition, and before it inside the partition, that have its key
        held = line.groupBy("pid_", "alike").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("alike").orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = held.select("pid_", "alike", before.alias("before"))
        inside = F.row_number().over(Window.partitionBy("pid_", "alike").orderBy("hash", "at"))
        placed = line.withColumn("turn", inside).join(starts, ["pid_", "alike"])
        met = lookup_join(placed, picks, "alike")
        turn = F.col("before") + F.col("turn")
        met = met.withColumn("times", F.floor(F.col("copies") / F.col("rows")) + (turn <= F.col("copies") % F.col("rows")).cast("long"))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("again")).select("row.*")
