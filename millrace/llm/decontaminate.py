"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (any non-ASCII byte counts as a letter), lower-cased A-Z. A
document and a benchmark item that share a seed, a run of ``least`` words, are tiled: the longest
run of unmarked words that both hold is marked again and again, until none of ``least`` words is left. Running
Karp-Rabin hashes of all runs of one length tell whether the two share such a run, and bisection over the
length finds the longest; all tiles of that length are marked in one pass, from the left of the document. Time and
memory of a pass grow with item plus document, never with the pairs of equal runs. The tiles never overlap,
so the share of an item's words under tiles, its coverage, also catches passages whose sentences were
reordered. A pair with coverage of at least ``threshold`` is reported.

The benchmark is the query side. It is taken in blocks of at most ``block_words`` words; every block is a
bounded broadcast that passes over all documents, and no document text is shuffled. Where there are several blocks,
each one's result is written to the shared folder before the next one is fetched, so the driver holds one.

Items of fewer than ``least`` words match nothing (a single common word is no leak), as do null texts and texts without
words; a null doc_id is not reported by ``leaks`` but judged like others by ``clean_rows``. Repeated rows of a
document are reported alike, repeated items once. Texts are tiled whole whatever their length; extra columns of any
name are left out by ``leaks`` and kept by ``clean_rows``. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, ordered, partition_offsets, scratch
from millrace.llm.wordhash import NOT_ALNUM, U64, mix64, slices, words

_BASE = 0xC2B2AE3D27D4EB4F
_BITS = 22


@dataclass(frozen=True)
class TilingParams:
    """``least`` words make a match, and an item; ``threshold`` of an item's words under tiles make a leak."""

    least: int = 5
    threshold: float = 0.5
    block_words: int = 2_000_000


def run_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``width`` words, from running sums: each power of the base weighs one place."""
    n = len(tokens) - width + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U64)
        for j in range(width):
            total = total * U64(_BASE) + tokens[j : n + j]
        return mix64(total)


class _Runs:
    """Running hashes of one word sequence, for runs of any length, and the words that are marked."""

    def __init__(self, tokens: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        self.tokens, self.down = tokens, down
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(tokens * up[: len(tokens)], dtype=U64)])
        self.marked = np.zeros(len(tokens), bool)
        self.count()

    def count(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(self.marked)])

    def free(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the runs of ``width`` unmarked words."""
        at = np.flatnonzero(self.before[width:] == self.before[:-width]) if width <= len(self.tokens) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return (self.sums[at + width] - self.sums[at]) * self.down[at], at

    def mark(self, start: int, width: int) -> None:
        self.marked[start : start + width] = True


_UNBASE = pow(_BASE, -1, 1 << 64)


def tiles(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in item, place in document, length), longest first.

    Of equally long matches the one first in the document comes first, at the first free place of the item.
    """
    if min(len(item), len(doc)) < width:
        return []
    shared = np.isin(run_hashes(doc, width), run_hashes(item, width))
    if not shared.any():
        return []
    n = max(len(item), len(doc)) + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.append(U64(1), np.full(n, _BASE, U64)), dtype=U64)
        down = np.cumprod(np.append(U64(1), np.full(n, _UNBASE, U64)), dtype=U64)
    a, b = _Runs(item, up, down), _Runs(doc, up, down)
    # words outside every shared run are in no tile
    covered = np.cumsum(np.concatenate([shared, np.zeros(width, bool)]).astype(np.int64) - np.concatenate([np.zeros(width, bool), shared]))
    b.marked |= covered[: len(doc)] == 0
    b.count()
    out, top = [], len(item)
    while True:
        low, high = width - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(b.free(middle)[0], a.free(middle)[0]).any():
                low = middle
            else:
                high = middle - 1
        if low < width:
            return out
        hashes, at = a.free(low)
        places: dict[int, list[int]] = {}
        for h, x in zip(hashes[::-1].tolist(), at[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(x)  # the first place is the last one of the list
        hashes, at = b.free(low)
        common = np.isin(hashes, np.fromiter(places, U64, len(places)))
        end = 0
        for h, y in zip(hashes[common].tolist(), at[common].tolist(), strict=True):
            if not places:
                break
            if y < end or h not in places:
                continue
            own = places[h]
            # a place that overlaps a tile is never free again
            while own and (a.marked[own[-1]] or a.marked[own[-1] + low - 1]):
                own.pop()
            if own and (item[own[-1] : own[-1] + low] == doc[y : y + low]).all():
                out.append((own[-1], y, low))
                a.mark(own[-1], low)
                b.mark(y, low)
                end = y + low
            if not own:
                del places[h]
        a.count()
        b.count()
        top = low - 1


def _tokens(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, raw, offsets in slices(pa.array(texts, pa.string())):
        hashes, bounds = words(raw, offsets, NOT_ALNUM)
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _scan(items: list[tuple[int, str]], params: TilingParams):
    """Leaks of a batch of documents against one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens([t for _, t in items])
        seeds, widths = {}, [params.least] if any(len(t) >= params.least for t in tokens) else []
        for width in widths:
            own = [n for n, t in enumerate(tokens) if len(t) >= width]
            hashes = [run_hashes(tokens[n], width) for n in own]
            owner = np.repeat(own, [len(h) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[(flat >> U64(64 - _BITS)).astype(np.int64)] = True
            seeds[width] = flat[order], owner[order], bits
        for batch in batches:
            out = {"doc_id": [], "item": [], "covered": [], "tiles": [], "longest": []}
            for at, _, raw, offsets in slices(batch.column(1)):
                hashes, bounds = words(raw, offsets, NOT_ALNUM)
                found = set()
                for width in widths:
                    flat, owner, bits = seeds[width]
                    runs = run_hashes(hashes, width)
                    place = np.flatnonzero(bits[(runs >> U64(64 - _BITS)).astype(np.int64)])
                    doc = np.searchsorted(bounds, place, "right") - 1
                    whole = place + width <= bounds[doc + 1]
                    place, doc = place[whole], doc[whole]
                    low = np.searchsorted(flat, runs[place], "left")
                    high = np.searchsorted(flat, runs[place], "right")
                    hit = np.flatnonzero(high > low)
                    for d, lo, hi in set(zip(doc[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)):
                        found.update((d, n) for n in owner[lo:hi].tolist())
                for d, n in sorted(found):
                    doc_id = batch.column(0)[at + d].as_py()
                    if doc_id is None:
                        continue
                    own = tokens[n]
                    marked = tiles(own, hashes[bounds[d] : bounds[d + 1]], params.least)
                    covered = sum(t[2] for t in marked)
                    if covered >= params.threshold * len(own):
                        for k, v in zip(out, (doc_id, items[n][0], covered / len(own), len(marked), marked[0][2]), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["item"], pa.int64()), pa.array(out["covered"], pa.float64()), pa.array(out["tiles"], pa.int32()), pa.array(out["longest"], pa.int32())],
                names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
            )

    return run


def blocks(benchmark: DataFrame, params: TilingParams) -> Iterator[list[tuple[int, str]]]:
    """The items in order of their ids, in blocks of about ``block_words`` words; one block at a time is on the driver."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("\\S+")), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), size.alias("n"))
    items = items.where("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    lines = ordered(items, ["item_id", "text"], 8)
    before = F.broadcast(partition_offsets(lines, before=F.col("n")))  # one row per partition
    inside = F.sum("n").over(Window.partitionBy("pid_").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    at = (F.col("before") + F.coalesce(inside, F.lit(0))) / F.lit(params.block_words)
    placed = lines.join(before, "pid_").select("item_id", "text", F.floor(at).alias("block"))
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        yield [(r.item_id, r.text) for r in placed.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """One row per document and benchmark item that leaks into it: doc_id, item_id, coverage, n_tiles, longest_tile."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"
    target, n, found = scratch(docs.sparkSession, "leaks"), 0, None
    for block in blocks(benchmark, params):
        if found is not None:
            found.write.parquet(f"{target}/block={n}")
            n += 1
        found = rows.mapInArrow(_scan(block, params), schema)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    if not n:
        return found  # the only block
    found.write.parquet(f"{target}/block={n}")
    return docs.sparkSession.read.schema(schema).parquet(target).select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def _drop(items: list[tuple[int, str]], params: TilingParams):
    """The rows, with all their columns, into which no item of the block leaks."""
    scan = _scan(items, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(held: list) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                # the row's number stands for its id, so rows without id are judged too
                yield pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text").cast(pa.string())], names=["doc_id", "text"])

        held: list[pa.RecordBatch] = []
        for found in scan(places(held)):
            batch = held.pop()
            leaked = np.zeros(batch.num_rows, bool)
            leaked[found.column(0).to_numpy()] = True
            yield batch.filter(pa.array(~leaked))

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """The rows, with all their columns, that no benchmark item leaks into; one pass per block, no shuffle."""
    first = True
    for block in blocks(benchmark, params):
        if not first:
            docs = checkpoint(docs)  # the block before is let go
        first = False
        docs = docs.mapInArrow(_drop(block, params), docs.schema)
    return docs
