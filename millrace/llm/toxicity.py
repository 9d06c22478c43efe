"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) to Latin letters, drops
invisible characters, reads digits and signs inside words as letters (``1d10t``), and reduces all else to
words with single spaces. The lexicon is a hand-written list of insults, and word beginnings and
whole words that labelled training rows show to mark toxic texts, each weighted by its log odds. Of
the entries that match at one word the longest counts; those inside an exception phrase don't.

The weights of a text add up, are normalised by its number of words, and a logistic curve gives the
score. The curve is fitted on two halves of the training rows, each scored with the lexicon of the
other half. Learning takes at most ``max_rows`` labelled rows (by hash order of the doc_id); scoring
reads whole texts of all rows.

Null and empty texts have no matches and get the curve's score for them; labels other than 0 and 1,
null ids and texts without label are not learned from; repeated rows are scored alike; without any training
row of both labels the hand-written list alone decides; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hand-written insults (whole words; plurals are added).
INSULTS = (
    "idiot moron imbecile cretin stupid dumb dumbass fool loser scum scumbag trash garbage worthless pathetic disgusting "
    "clown pig bastard bitch asshole jackass dipshit bullshit shit crap fuck fucking fucker motherfucker slut whore retard "
    "freak creep vermin filth parasite degenerate subhuman lowlife dimwit halfwit nitwit airhead"
).split()
#: Phrases in which such a word is no insult.
EXCEPTIONS = (
    "clown fish", "class clown", "trash can", "trash bin", "trash bag", "garbage collection", "garbage collector", "garbage can",
    "guinea pig", "pig iron", "control freak", "freak accident", "creep strain", "fool proof", "april fool", "pathetic fallacy",
)
#: Look-alike letters, and what they are read as.
HOMOGLYPHS = dict(zip("абвеёзіїјкмнорстухуѕԁһαβεικνορτυχ", "abbeeziijkmhopctyxysdhabeiknoptux", strict=True))
#: Digits and signs that stand for letters inside words.
LEET = dict(zip("0134578@$!", "oieastbasi", strict=True))

_ODD = re.compile("[­Ͱ-ԯ​-‏⁠﻿！-～]")
_ODD_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
_ODD_TABLE |= dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_SIGN = re.compile("[0134578@$!]")
_INSIDE = re.compile(r"(?<=[a-z])[@$!0134578]+(?=[a-z])|(?<![\w@$])[@$0134578]+(?=[a-z])")
_LEET_TABLE = str.maketrans(LEET)
_BREAK = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded text: words with one space around each."""
    low = (text or "").lower()
    if _ODD.search(low):
        low = low.translate(_ODD_TABLE)
    if _SIGN.search(low):
        low = _INSIDE.sub(lambda m: m.group().translate(_LEET_TABLE), low)
    return f" {_BREAK.sub(' ', low).strip()} "


@dataclass(frozen=True)
class Model:
    """Lexicon weights (entries begin with a space; whole words end with one) and the curve's coefficients."""

    weights: dict[str, float]
    coef: tuple[float, ...] = (-3.0, 1.0, 0.3, 0.0)
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)


class Matcher:
    """The automaton of a lexicon and its exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def total(self, folded: str) -> float:
        """The added weights of the longest entry at each word, outside exception phrases."""
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            else:
                best[start] = weight  # longer entries at the same start end later
        if safe:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in safe)}
        return sum(best.values())


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    total = np.maximum(total, 0.0)
    return np.stack([np.ones_like(total), np.log1p(total), np.sqrt(100 * total / np.maximum(words, 20)), np.log1p(words) * (total > 0)], 1)


def _chance(coef: tuple[float, ...], total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(total, words) @ np.array(coef), -30, 30)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.exceptions)
        for batch in batches:
            folded = [fold(t) for t in batch.column(1).to_pylist()]
            total = np.array([matcher.total(f) for f in folded], np.float64)
            words = np.array([f.count(" ") - 1 if len(f) > 2 else 0 for f in folded], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_chance(model.coef, total, words))], names=["doc_id", "score"])

    return run


def _flag(model: Model):
    """The rows themselves, where the score is below one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.exceptions)
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            total = np.array([matcher.total(f) for f in folded], np.float64)
            words = np.array([f.count(" ") - 1 if len(f) > 2 else 0 for f in folded], np.float64)
            yield batch.filter(pa.array(_chance(model.coef, total, words) < 0.5))

    return run


def _entries(folded: str, shortest: int = 5, longest: int = 11) -> set[str]:
    """Beginnings (with the space before the word) and whole words of a folded text."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(shortest - 1, min(len(word), longest - 1) + 1))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per entry, half and label, added up per batch. Column 0: half * 2 + label; column 1: text."""
    for batch in batches:
        counts = [Counter() for _ in range(4)]
        for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[kind].update(_entries(fold(text)))
        names = list(set().union(*counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["entry", "c0", "t0", "c1", "t1"]
        )


def base_weights() -> dict[str, float]:
    return {f" {w}{s} ": 2.0 for w in INSULTS for s in ("", "s")}


def _lexicon(rows: list, parts: tuple[int, ...], docs: np.ndarray, least: int) -> dict[str, float]:
    """Weights from the counts of some halves. docs: documents by half and label."""
    clean, toxic = (docs[[2 * p + y for p in parts]].sum() for y in (0, 1))
    out = base_weights()
    for r in rows:
        c, t = sum(r[f"c{p}"] for p in parts), sum(r[f"t{p}"] for p in parts)
        weight = float(np.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))))
        if r["entry"] in out:
            out[r["entry"]] = max(0.0, (out[r["entry"]] * 2 + weight * t) / (2 + t))
        elif t >= least and weight > 0.7:
            out[r["entry"]] = weight
    return out


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """A model of labelled rows whose crc32(doc_id) mod 5 is not 0: at most ``max_rows`` rows, and all the entries that they show to be toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select((half * 2 + F.col("toxic")).cast("int").alias("kind"), "text")  # max_rows rows
    docs_by_kind = np.zeros(4)
    for kind, n in rows.groupBy("kind").count().collect():
        docs_by_kind[kind] = n
    if docs_by_kind[[0, 2]].sum() < 5 or docs_by_kind[[1, 3]].sum() < 5:
        return Model(base_weights())
    counted = rows.mapInArrow(_count, "entry string, c0 long, t0 long, c1 long, t1 long")
    sums = counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    ratio = F.log(((toxic + 0.5) / float(docs_by_kind[[1, 3]].sum() + 1)) / ((clean + 0.5) / float(docs_by_kind[[0, 2]].sum() + 1)))
    wanted = F.col("entry").isin(list(base_weights())) | ((toxic >= 4) & (ratio > 0.7))
    found = [r.asDict() for r in sums.where(wanted).orderBy("entry").collect()]  # bounded by max_rows
    halves = [_lexicon(found, (1,), docs_by_kind, 3), _lexicon(found, (0,), docs_by_kind, 3)]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(w, EXCEPTIONS) for w in halves]
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            folded = [fold(t) for t in batch.column(1).to_pylist()]
            total = [matchers[k // 2].total(f) for k, f in zip(kinds, folded, strict=True)]
            words = [float(f.count(" ") - 1 if len(f) > 2 else 0) for f in folded]
            yield pa.RecordBatch.from_arrays([pa.array([k % 2 for k in kinds], pa.int32()), pa.array(total, pa.float64()), pa.array(words, pa.float64())], names=["y", "total", "words"])

    seen = np.array(sorted(tuple(r) for r in rows.mapInArrow(crossed, "y int, total double, words double").collect()), np.float64)
    coef = _fit(_features(seen[:, 1], seen[:, 2]), seen[:, 0])
    return Model(_lexicon(found, (0, 1), docs_by_kind, 4), coef)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that score below one half."""
    return docs.mapInArrow(_flag(model), docs.schema)
