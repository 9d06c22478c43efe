"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles (lower-cased A-Z, white-space words). One permutation
``sigma`` scatters the shingles over 2**32 positions, a second one ``pi`` is circularly shifted once
per coordinate: coordinate k is min over the set of ``pi(sigma(x) + k mod 2**32)``. Bands of
coordinates give buckets. Documents with equal sets are one class before banding; only class
representatives enter buckets.

Links are found without listing all pairs of a bucket: each round pairs every member with one pivot
of its bucket whose component differs, verifies on full sets and joins components. Once few pairs of
different components are left in shared buckets, all of those are verified (in blocks), so every
bucket pair ends in one component or is known not to be a link.

Where many pairs stay open in shared buckets after the pivots, the open members are dealt anew by an exact
prefix filter: two sets at the threshold share one of the rarest shingles of both, so wide buckets
of texts that only look alike fall apart before pairs are listed.

Null, empty and blank texts have the empty set (``n_shingles`` 0) and are linked with nothing; a
document with fewer words than the shingle width has its whole word sequence as one shingle. Rows of one
doc_id give one output row each and are one vertex: whatever texts they hold, they join their groups, and
``deduplicated`` keeps one row of them at most. Rows with a null doc_id take the group of an equal text but
never lead or join groups; without such a text their component is null. Extra columns of any name and
texts of any length are fine; an empty table gives no rows.

Sets hold 64-bit shingle hashes, so n_shingles and links are exact up to collisions of these (a set of
20,000 shingles has one with probability of about 1e-11).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import HOT_ROWS, MAX_HOT_KEYS, checkpoint, compact, lookup_join
from millrace.llm.wordhash import U64, mix64, shingles, slices, words

#: 64-bit words of the parity sketch.
ODD_WORDS = 8
SKETCH = ("s0", "s1", *(f"o{i}" for i in range(ODD_WORDS)))
#: Shingles that are hashed at a time.
CHUNK = 1 << 15
#: Members of a bucket that meet in one task when the last pairs are listed.
BLOCK = 512
#: Comparisons for each open member of a bucket up to which the last pairs are listed.
LAST_PAIRS = 200
#: Most rounds of pivots before that.
ROUNDS = 5


@dataclass(frozen=True)
class MinHashParams:
    """``threshold`` is a percentage; with 48 bands of 5 a pair at 75 % is missed with probability 2e-6.

    Two sketches spare pairs the verification. Of each of the first 128 coordinates one bit is kept: sets
    at 75 % agree in 112 of the 128 bits (standard deviation 3.7), and pairs that agree in fewer than
    ``agree`` are left out (a pair at 75 % with probability of about 6.5e-9). And of each of 512 cells over which the
    shingles are scattered the parity of their number is kept: the cells that differ are at most the
    shingles that differ, so pairs with too many of them surely are below the threshold.
    """

    width: int = 5
    threshold: int = 75
    bands: int = 48
    rows: int = 5
    agree: int = 88


def _sigma(x: np.ndarray) -> np.ndarray:
    """64-bit shingle hashes to positions among 2**32."""
    return (mix64(x ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


def circulant_signatures(hashes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of each non-empty set, as an array (sets, size) of uint32."""
    sets = len(bounds) - 1
    out = np.empty((size, sets), np.uint32)
    at = 0
    while at < sets:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        place = _sigma(hashes[bounds[at] : bounds[end]])
        edges = (bounds[at:end] - bounds[at]).astype(np.intp)
        t, s = np.empty_like(place), np.empty_like(place)
        for k in range(size):
            np.add(place, np.uint32(k), out=t)
            np.right_shift(t, 16, out=s)
            np.bitwise_xor(t, s, out=t)
            np.multiply(t, np.uint32(0x7FEB352D), out=t)
            np.right_shift(t, 15, out=s)
            np.bitwise_xor(t, s, out=t)
            np.multiply(t, np.uint32(0x846CA68B), out=t)
            np.right_shift(t, 16, out=s)
            np.bitwise_xor(t, s, out=t)
            out[k, at:end] = np.minimum.reduceat(t, edges)
        at = end
    return out.T


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), U64)
    parts = signature.reshape(len(signature), bands, rows).astype(U64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix64(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, r] + U64(1))
        return mix64(keys + np.arange(bands, dtype=U64) * U64(0xD1342543DE82EF95))


def _sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 coordinates, as two 64-bit words."""
    bits = np.packbits((signature[:, :128] & np.uint32(1)).astype(bool), axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.int64)


def _odd_sketch(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each cell, per set."""
    cells = 64 * ODD_WORDS
    at = np.repeat(np.arange(len(bounds) - 1) * cells, np.diff(bounds)) + (mix64(sets ^ U64(0x2545F4914F6CDD1D)) % U64(cells)).astype(np.int64)
    odd = np.bincount(at, minlength=(len(bounds) - 1) * cells).reshape(-1, cells) & 1
    return np.ascontiguousarray(np.packbits(odd.astype(bool), axis=1, bitorder="little")).view(np.int64)


def _distinct_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their bounds."""
    hashes, bounds = shingles(*words(raw, offsets), width)
    if len(hashes) == 0:
        return hashes, bounds
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _arrow_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(params: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for at, end, raw, offsets in slices(text):
                sets, bounds = _distinct_sets(raw, offsets, params.width)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                n = end - at
                own = np.array(ids.slice(at, n).fill_null(0), np.int64)
                # empty sets are told apart by their ids; without id the two halves are alike, which no id gives
                h1, h2 = own.copy(), np.where(np.array(ids.slice(at, n).is_null()), own, ~own)
                keys = np.zeros(0, U64)
                sketch = np.zeros((n, len(SKETCH)), np.int64)
                if len(full):
                    edges = np.append(bounds[full], bounds[-1])
                    with np.errstate(over="ignore"):
                        h1[full] = np.add.reduceat(mix64(sets + U64(1)), edges[:-1]).view(np.int64)
                        h2[full] = np.add.reduceat(mix64(sets ^ U64(0xA5A5A5A55A5A5A5A)), edges[:-1]).view(np.int64)
                    signature = circulant_signatures(sets, edges, params.bands * params.rows)
                    keys = _band_keys(signature, params.bands, params.rows).ravel()
                    sketch[full] = np.hstack([_sketch(signature), _odd_sketch(sets, edges)])
                held = np.concatenate([[0], np.cumsum((size > 0) * params.bands)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(size.astype(np.int64)), pa.array(h1), pa.array(h2), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T), _arrow_lists(keys, held)],
                    names=["doc_id", "n_shingles", "h1", "h2", *SKETCH, "bands"],
                )

    return run


def _full_sets(width: int):
    """id and its distinct shingles; a set that the last rows of the same id had is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, set()
        for batch in batches:
            for at, end, raw, offsets in slices(batch.column(1)):
                ids = batch.column(0).slice(at, end - at)
                sets, bounds = _distinct_sets(raw, offsets, width)
                new = []
                for i, id_ in enumerate(ids.to_pylist()):
                    if id_ != last:
                        last, had = id_, set()
                    own = hash(sets[bounds[i] : bounds[i + 1]].tobytes())
                    new.append(own not in had)
                    had.add(own)
                out = pa.RecordBatch.from_arrays([ids, _arrow_lists(sets, bounds)], names=["id", "items"])
                yield out if all(new) else out.filter(pa.array(new))

    return run


def signatures(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, a 128-bit set hash (h1, h2), two sketches and the band keys of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sign(params), f"doc_id long, n_shingles long, h1 long, h2 long, {', '.join(f'{c} long' for c in SKETCH)}, bands array<long>"
    )


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked id: the smallest id of its component. ``links``: columns a, b.

    Alternates large-star and small-star steps until the edges no longer change; every step is a
    group minimum (partially aggregated) and a skew-safe join.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = compact(edges), None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if (n, total) == before or not n:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
            )
        before = (n, total)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = lookup_join(both.where("v > u"), least, "u", rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, down, "u", rows=n)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        edges = compact(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A pivot ``b`` of many pairs is dealt over copies."""
    share = 200
    rows = pairs.count()
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies"))
    left = lookup_join(pairs, many, "b", rows=rows).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    left = left.join(sets.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a")
    right = many.join(sets.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = left.join(right, ["b", "salt"])
    both = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - both
    return met.where(100 * both.cast("long") >= threshold * union.cast("long")).select("a", "b")


def _could_link(x: str, y: str, params: MinHashParams):
    """Sizes of which the smaller can be the threshold's share of the larger, and sketches that agree enough."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH]
    close = differ[0] + differ[1] <= 128 - params.agree
    # at the threshold t the symmetric difference is (100 - t) / (100 + t) of both sizes
    odd = reduce(lambda a, b: a + b, differ[2:])
    return (100 * F.least(n, m) >= params.threshold * F.greatest(n, m)) & close & (odd * (100 + params.threshold) <= (n + m) * (100 - params.threshold))


def _pivot_pairs(members: DataFrame, salt: int, params: MinHashParams, hot: list) -> DataFrame:
    """Every member with one pivot of its bucket, where their components differ."""
    order = F.xxhash64("own.id", F.lit(salt)) if salt else F.col("own.id")
    pivot = members.groupBy("bucket").agg(F.min_by(F.struct("own", "label"), order).alias("p"))
    pivot = pivot.select("bucket", F.col("p.own").alias("pivot"), F.col("p.label").alias("pivot_label"))
    met = lookup_join(members, pivot, "bucket", hot=hot).where((F.col("label") != F.col("pivot_label")) & _could_link("own", "pivot", params))
    return met.select(F.col("own.id").alias("a"), F.col("pivot.id").alias("b")).distinct()


def _rest_pairs(members: DataFrame, sizes: DataFrame, params: MinHashParams, hot: list) -> DataFrame:
    """All pairs of different components that share a bucket; large buckets are cut into blocks that meet pairwise."""
    cut = lookup_join(members, sizes.select("bucket", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "bucket", hot=hot)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("own.id"), F.col("blocks")).cast("int"))
    left = cut.select("bucket", "own", "label", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    right = cut.select("bucket", F.col("own").alias("other"), F.col("label").alias("other_label"), F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"))
    met = left.join(right, ["bucket", "x", "y"]).where(
        (F.col("label") != F.col("other_label")) & ((F.col("x") != F.col("y")) | (F.col("own.id") < F.col("other.id"))) & _could_link("own", "other", params)
    )
    return met.select(F.greatest("own.id", "other.id").alias("a"), F.least("own.id", "other.id").alias("b")).distinct()


def _hot_buckets(sizes: DataFrame) -> list:
    """Buckets that a lookup join treats as hot. ``sizes``: bucket, held."""
    least = max(HOT_ROWS, (sizes.agg(F.sum("held")).first()[0] or 0) // MAX_HOT_KEYS + 1)
    return [r[0] for r in sizes.where(F.col("held") >= least).select("bucket").collect()]


def _several_texts(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of doc_ids that lie on several texts; None where there are none."""
    set_ = F.struct("h1", "h2", "n_shingles")
    many = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(set_).alias("x"), F.max(set_).alias("y")).where("x != y")
    many = compact(many.select("doc_id"))
    if many.isEmpty():
        return None
    held = signed.join(many, "doc_id").select("doc_id", "h1", "h2", "n_shingles").distinct()
    return compact(held.join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))


def _prefix_members(wide: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """bucket and own of each text by each of its rarest shingles, as many as a set at the threshold may lack and one.

    Two sets at the threshold share ceil(threshold * n / 100) shingles at least of either's n, so in
    one common order they share one of the first n - ceil(threshold * n / 100) + 1 of both.
    """
    items = wide.select("own", F.col("own.id").alias("id")).join(sets, "id").select("own", F.explode("items").alias("x"))
    often = checkpoint(items.groupBy("x").agg(F.count(F.lit(1)).alias("f")))
    ranked = lookup_join(items, often, "x").groupBy("own").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("xs"))
    n = F.size("xs")
    keep = n - F.ceil(n * F.lit(threshold) / 100).cast("int") + 1
    return checkpoint(ranked.select("own", F.explode(F.slice("xs", F.lit(1), keep)).alias("e")).where("e.f > 1").select(F.col("e.x").alias("bucket"), "own"))


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    signed = checkpoint(signatures(docs, params))
    classes = signed.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in (*SKETCH, "bands")])
    classes = checkpoint(classes)
    leads = classes.where("rep is not null and n_shingles > 0")
    banded = leads.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = checkpoint(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    hot = _hot_buckets(shared)
    members = lookup_join(banded, shared.select("bucket"), "bucket", hot=hot)
    own = leads.select(F.col("rep").alias("id"), F.struct(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), *SKETCH).alias("own"))
    members = checkpoint(members.join(own, "id").select("bucket", "own"))
    wanted = members.select(F.col("own.id").alias("id")).distinct()
    sets = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id")
    sets = checkpoint(sets.mapInArrow(_full_sets(params.width), "id long, items array<long>"))
    links, labels = _several_texts(signed, classes), None
    if links is not None:
        labels = components(links)
    for stage in (members, None):
        if stage is None:
            # what is still open meets by the rarest shingles instead of the bands
            wide = checkpoint(open_.select("own").distinct())
            members = _prefix_members(wide, sets, params.threshold)
            hot = _hot_buckets(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")))
        done = False
        for round_ in range(ROUNDS + 1):
            known = members.join(labels, members["own.id"] == labels["id"], "left").drop("id") if labels is not None else members.withColumn("label", F.lit(None).cast("long"))
            known = known.select("bucket", "own", F.coalesce("label", "own.id").alias("label"))
            last, open_ = False, known
            if round_:
                inside = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
                sizes = inside.groupBy("bucket").agg(F.sum("k").alias("held"), F.sum(F.col("k") * F.col("k")).alias("within"))
                sizes = checkpoint(sizes.where("held * held > within"))
                left, cross = sizes.agg(F.sum("held"), F.sum((F.col("held") * F.col("held") - F.col("within")) / 2)).first()
                if not cross:
                    done = True
                    break
                open_ = lookup_join(known, sizes.select("bucket"), "bucket", hot=hot)
                few = cross <= LAST_PAIRS * left
                if round_ == ROUNDS and not few and stage is not None:
                    break
                last = few or round_ == ROUNDS
            pairs = _rest_pairs(open_, sizes, params, hot) if last else _pivot_pairs(open_, round_, params, hot)
            found = compact(verified(compact(pairs), sets, params.threshold))
            links = found if links is None else links.unionByName(found)
            labels = components(links)
            if last:
                done = True
                break
        if done:
            break
    grouped = classes.select("h1", "h2", "n_shingles", F.col("rep").alias("id"))
    if labels is not None:
        grouped = grouped.join(labels, "id", "left").withColumn("id", F.coalesce("label", "id"))
    grouped = grouped.select(F.struct("h1", "h2", "n_shingles").alias("set"), F.col("id").alias("component_id"))
    rows = signed.select("doc_id", F.struct("h1", "h2", "n_shingles").alias("set"))
    out = lookup_join(rows, grouped, "set")
    return out.select(
        "doc_id", F.col("set.n_shingles").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def deduplicated(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """The rows, with all their columns, of one document per group. Rows with a null doc_id can't be told apart and stay."""
    kept = checkpoint(near_duplicates(docs, params).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    known = docs.join(kept.select("doc_id"), docs["doc_id"].cast("long") == kept["doc_id"], "left_semi")
    twice = checkpoint(kept.where("n > 1").select(F.col("doc_id").alias("id_")))
    if not twice.isEmpty():
        own = docs["doc_id"].cast("long")
        once = known.join(twice, own == twice["id_"], "left_anti")
        # of rows that share the kept doc_id, the one of least hash: which one it is does not depend on the partitioning
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = known.join(twice, own == twice["id_"], "left_semi").select(own.alias("id_"), whole.alias("row_"))
        again = again.groupBy("id_").agg(F.min_by("row_", F.struct(F.xxhash64("row_.text"), F.hash("row_"))).alias("row_"))
        known = once.unionByName(again.select("row_.*"))
    return known.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
