"""The training-data operators against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from twins import same

from millrace.llm import chat, decontaminate, licenses, minhash, mixing, queries, shards, stream_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, n long, bucket string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def odd_texts():
    """Null, empty, blank, short, repeated, very long, near copies and multi-byte texts."""
    r, vocab = random.Random(5), vocabulary(3000)
    base = [r.choice(vocab) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    far = base[:60] + [r.choice(vocab) for _ in range(60)]
    long = " ".join(r.choice(vocab) for _ in range(40_000))
    texts = [None, "", " \n\t ", "one two", "ONE two", "one two", " ".join(base), " ".join(near), " ".join(far), "Ünï çødé " * 30, long, long, " ".join(base).upper()]
    return texts + [" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 0, 0.5, "x", 1, "b") for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[6]]  # repeated rows
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(pairs):
    sets = {}
    for i, t in pairs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_matches_brute_force(docs, none):
    rows = docs.select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, r.text) for r in rows])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *w) for i, w in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicated(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()})


def test_minhash_large_group_and_null_id(spark):
    r, vocab = random.Random(3), vocabulary(2000)
    base = [r.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(i % 9):
            copy[r.randrange(150)] = r.choice(vocab)
        rows.append((i, " ".join(copy)))
    want = brute_components(rows)
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: c for i, (_, c) in want.items()}
    assert [r.kept for r in got if r.doc_id is None] == [False]


def test_minhash_rest_pairs_equal_rounds(spark, monkeypatch):
    """Listing the last pairs in many blocks, or after more pivot rounds, gives the same groups."""
    r, vocab = random.Random(9), vocabulary(500)
    base = [r.choice(vocab) for _ in range(100)]
    rows = [(i, " ".join(w if r.random() > i / 600 else r.choice(vocab) for w in base)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(minhash, "LAST_PAIRS", 0)
    monkeypatch.setattr(minhash, "ROUNDS", 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want


def test_minhash_one_id_on_several_texts(spark):
    """A doc_id is one vertex: its texts join their groups, and one row of a group stays."""
    r, vocab = random.Random(11), vocabulary(800)
    x, y, z = (" ".join(r.choice(vocab) for _ in range(60)) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (9, y), (11, z), (11, ""), (12, ""), (None, ""), (None, z), (None, "its own text of more than five words"), (-1, ""), (13, None), (13, None)]
    df = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, id_ int, label string")
    got = Counter((q.doc_id, q.n_shingles > 0, q.component_id) for q in minhash.near_duplicates(df).collect())
    assert got == Counter([(3, True, 3), (5, True, 3), (5, True, 3), (9, True, 3), (11, True, 11), (11, False, 11), (12, False, 12), (None, False, None), (None, True, 11), (None, True, None), (-1, False, -1), (13, False, 13), (13, False, 13)])
    kept = minhash.deduplicated(df.drop("id_")).where("doc_id is not null").collect()
    assert sorted(q.doc_id for q in kept) == [-1, 3, 11, 12, 13] and next(q.text for q in kept if q.doc_id == 3) == x


def test_minhash_wide_buckets_meet_by_rare_shingles(spark, monkeypatch):
    """Pages of one template that are no near copies share buckets; pivots settle none, the prefix filter does."""
    r, vocab = random.Random(12), vocabulary(4000)
    base = [r.choice(vocab) for _ in range(140)]
    rows = [(i, " ".join(base + [r.choice(vocab) for _ in range(60)])) for i in range(60)]
    rows += [(100 + i, t + " one more word") for i, (_, t) in enumerate(rows[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    assert len(set(want.values())) == 60
    monkeypatch.setattr(minhash, "LAST_PAIRS", 0)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    listed = []
    real = minhash._rest_pairs
    monkeypatch.setattr(minhash, "_rest_pairs", lambda o, *a: listed.append(o.count()) or real(o, *a))
    assert {q.doc_id: q.component_id for q in minhash.near_duplicates(df).collect()} == want
    assert listed == [] or max(listed) < 60


def test_mix_invariants(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.taken) for r in mixing.mixed(docs.repartition(5)).collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert all(0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) < max(r.size for r in own) + 1e-6
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mixed(none).count() == 0
    taken = mixing.taken_rows(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in got)


def brute_mix(rows, seed=42, block_rows=4, fan_in=2):
    """The mix in plain Python: targets by refilling, blocks and levels of the tree one by one."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, s, t in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * rest / open_ >= 2 * total[s]}
        if not over or capped | over == set(order):
            break
        capped |= over
    return {s: 2 * total[s] if s in capped or s in over else weight[s] * rest / open_ for s in order}, total


def test_mix_matches_brute_force(spark, docs):
    """Targets, sizes and the law of copies against plain Python; null and repeated ids, clashing columns."""
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()] + [(None, "s1", f"{'w ' * (i % 7)}x") for i in range(60)] + [(77, "s2", "a b c")] * 9
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, copies long, `row` int")
    want, total = brute_mix(rows)
    got = mixing.mixed(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    for s, n in total.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(want[s])
        rate = want[s] / n if n else 0
        assert all(r.taken in (int(rate) * r.size, (int(rate) + 1) * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < max(r.size for r in own) + 1e-6
    taken = Counter(r for r in mixing.taken_rows(df).collect())
    assert sum(taken.values()) == sum(r.copies for r in got) and set(taken) <= set(df.collect())
    by = Counter()
    for r in got:
        by[r.doc_id, r.source, r.size] += r.copies
    assert {(k.doc_id, k.source, size(k.text)): n for k, n in taken.items() if k.doc_id == 6} == {k: n for k, n in by.items() if k[0] == 6 and n}


def test_a_null_id_spreads_over_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(None if i < 300 else i, "s", f"{'w ' * (i % 3)}x") for i in range(350)], "doc_id long, source string, text string")
    rows = mixing._numbered(df.select(*mixing._key(df)))
    blocks = Counter(r.b for r in rows.select(F.pmod(F.xxhash64(F.lit(42), "doc_id", "size", "number"), F.lit(35)).alias("b")).collect())
    assert sum(blocks.values()) == 350 and max(blocks.values()) < 30
    monkeypatch.setattr(mixing, "NUMBERED", 7)
    assert mixing._numbered(df.select(*mixing._key(df))).distinct().count() == 350


def test_pivot_keeps_mass_and_expectation():
    for u in (0.0, 0.3, 0.999):
        a, b = [1, 30, 0.4], [2, 70, 0.7]
        mixing.pivot(a, b, u)
        assert 30 * a[2] + 70 * b[2] == pytest.approx(30 * 0.4 + 70 * 0.7)
        assert a[2] in (0.0, 1.0) or b[2] in (0.0, 1.0)
    draws = []
    for i in range(4000):
        a, b = [1, 30, 0.4], [2, 70, 0.7]
        mixing.pivot(a, b, (i + 0.5) / 4000)
        draws.append(a[2])
    assert sum(draws) / 4000 == pytest.approx(0.4, abs=0.01)


def test_targets_are_refilled(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources, [3, 1, 2], 1.5, 2.0).collect()}
    assert got["a"] == 20 and got["c"] == 0
    assert sum(got.values()) == pytest.approx(1.5 * 2010)
    # by rank a, b, c and null weigh 3, 1, 2, 3: after a and c the rest is 2995, of which null would get
    # 2246.25, above twice its size; so it stops at 2000 and b gets what is left
    assert got[None] == 2000 and got["b"] == pytest.approx(3015 - 20 - 2000)


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 5000 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", "<p>" + "a" * 200), (2, "http://b/\r\nX: y", "<p>" + "a" * 200), (3, None, None), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/", big), (1, "http://f/", "<p>" + "a" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    mono, normal = f"file://{tmp_path}/mono", f"file://{tmp_path}/normal"
    warc.write_monolithic(warc.records(pages), mono)
    index = warc.normalise(spark, mono, normal)
    got = warc.read_records(warc.read_index(spark, normal)).collect()
    assert len(got) == index.count() == len(rows)
    kinds = Counter((r.record_id, r.record_type) for r in got)
    assert kinds == Counter({("<urn:x-page:1>", "response"): 1, ("<urn:x-page:1>", "revisit"): 1, ("<urn:x-page:2>", "revisit"): 1, **{(f"<urn:x-page:{i}>", "response"): 1 for i in (3, 4, 5, 6)}})
    by = {r.record_id: r for r in got if r.record_type == "response"}
    assert by["<urn:x-page:6>"].payload.decode() == big
    assert by["<urn:x-page:3>"].payload_bytes == 0
    assert all(r.digest == hashlib.sha256((dict((f"<urn:x-page:{a}>", c) for a, _, c in rows)[r.record_id] or "").encode()).hexdigest() for r in got)
    for f in (tmp_path / "normal").glob("*.warc.gz"):  # members can be read one by one, the file as a whole too
        whole = gzip.decompress(f.read_bytes())
        assert whole.count(b"WARC-Record-ID") == whole.count(b"Content-Length: ")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(empty).count() == 0


def test_warc_survives_lost_and_doubled_attempts(spark, tmp_path, monkeypatch):
    """What attempts that did not finish leave behind is never read, and a second run of a task changes nothing."""
    rows = [(i, "http://a/", "payload %d " % i * 40, 1, "x") for i in range(20)] + [(None, None, "y" * 3_000_000, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int, digest string").repartition(3)
    mono, normal = f"file://{tmp_path}/mono", f"file://{tmp_path}/normal"
    warc.write_monolithic(warc.records(pages), mono)
    sweep = warc._sweep
    monkeypatch.setattr(warc, "_sweep", lambda *a: None)
    index = warc.normalise(spark, mono, normal)
    done = sorted((tmp_path / "normal").glob("*.warc.gz"))
    (tmp_path / "normal" / "part-0.lost.warc.gz").write_bytes(done[0].read_bytes())
    (tmp_path / "normal" / "part-0.lost.warc.gz.idx").write_bytes((tmp_path / "normal" / f"{done[0].name}.idx").read_bytes()[:60])
    again = warc._normalise(normal, 6)  # a doubled task: other names, not in the manifest
    import pyarrow as pa

    path = sorted((tmp_path / "mono").glob("*.gz"))[0]
    list(again(iter([pa.RecordBatch.from_arrays([pa.array([f"file://{path}"])], names=["path"])])))
    read = lambda: sorted((r.record_id, r.payload_bytes) for r in warc.read_records(warc.read_index(spark, normal)).collect())
    before = read()
    assert len(before) == 21 == index.count() and ("<urn:x-page:>", 3_000_000) in before
    sweep(spark, normal)
    assert sorted((tmp_path / "normal").glob("*.warc.gz")) == done and read() == before
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_monolithic(warc.records(empty), f"{mono}0")
    warc.normalise(spark, f"{mono}0", f"{normal}0")
    assert warc.read_records(warc.read_index(spark, f"{normal}0")).count() == 0


def test_inflating_is_bounded():
    """A chunk that inflates to 200 MB comes in pieces; a cut archive is refused."""
    import io

    raw = gzip.compress(b"z" * 200_000_000) + gzip.compress(b"end")
    total, largest = 0, 0
    for piece in warc._inflated(io.BytesIO(raw)):
        total, largest = total + len(piece), max(largest, len(piece))
    assert total == 200_000_003 and largest <= warc.PIECE
    with pytest.raises(ValueError):
        list(warc._inflated(io.BytesIO(gzip.compress(bytes(range(256)) * 50)[:-20])))


def test_split_records_refuses_cut_archives():
    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r for _, r in warc.split_records(iter([whole[:20], whole[20:], whole]))] == [whole, whole]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([whole[:-6]])))


def test_shards_match_brute_force(docs, none):
    got = shards.byte_balanced(docs, 5).collect()
    rows = sorted((hashlib.sha256((r.text or "").encode()).digest(), r.doc_id, (r.text or "").encode()) for r in docs.collect())
    total, at, want = sum(len(t) + 8 for *_, t in rows), 0, []
    for _, i, t in rows:
        size = len(t) + 8
        want.append((i, size, zlib.crc32(t), min(4, (2 * at + size) * 5 // (2 * total))))
        at += size
    assert Counter((r.doc_id, r.size, r.crc, r.shard) for r in got) == Counter(want)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shards.byte_balanced(none).count() == 0


def test_stream_dedup_matches_brute_force(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    rows = docs.collect()
    keep = {}
    for r in rows:
        keep.setdefault(r.text or "", []).append(r.doc_id)
    want = Counter((r.doc_id, max(keep[r.text or ""]), len(keep[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    for size in (None, 64 << 30, 1):  # some micro-batches, one, and one per file
        got = stream_dedup.exact_duplicates(spark, path, size).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_stream_dedup_odd_paths_and_inputs(spark, tmp_path):
    path = str(tmp_path / "docs [1]{a}")
    rows = [(None, "same"), (4, "same"), (5, None), (None, ""), (7, "own " * 100_000), (7, "own " * 100_000)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, `row` int").repartition(2).write.parquet(path)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_duplicates(spark, path + "/").collect())
    assert got == Counter([(None, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (None, 5, 2, False), (7, 7, 2, True), (7, 7, 2, True)])
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert stream_dedup.exact_duplicates(spark, empty).count() == 0


def test_stream_dedup_survives_a_digest_collision(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string").write.parquet(path)
    real = stream_dedup._fingerprints
    monkeypatch.setattr(stream_dedup, "_fingerprints", lambda d: real(d).withColumn("digest", F.when(F.col("text") == "c", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup.exact_duplicates(spark, path).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_tiling_catches_reordered_passages(spark):
    vocab = vocabulary(2000)
    r = random.Random(2)
    item = [r.choice(vocab) for _ in range(40)]
    filler = lambda n: [r.choice(vocab) for _ in range(n)]
    moved = item[20:30] + filler(20) + item[:10] + filler(5) + item[10:20]
    rows = [(0, None), (1, ""), (2, " ".join(filler(300))), (3, " ".join(filler(50) + item + filler(50))), (4, " ".join(moved)), (5, " ".join(item[:12] + filler(200))), (6, "!".join(item).upper()), (None, " ".join(item)), (3, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "..."), (7, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(3, 7), (3, 7), (4, 7), (6, 7)]
    assert {x.doc_id: (x.coverage, x.n_tiles) for x in got}[4] == (0.75, 3)
    assert sorted(x.doc_id for x in decontaminate.clean_rows(docs, bench).where("doc_id is not null").collect()) == [0, 1, 2, 5]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    small = decontaminate.TilingParams(block_words=1)
    assert decontaminate.leaks(docs, bench, small).count() == len(got)


def brute_tiles(a, b, width):
    """All pairs of places, the longest free match first; ties by place in the document, then in the item."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for y in range(len(b)):
            for x in range(len(a)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and free_a[x + n] and free_b[y + n]:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (x, y, n)
        if best is None:
            return out
        out.append(best)
        x, y, n = best
        free_a[x : x + n] = [False] * n
        free_b[y : y + n] = [False] * n


def test_tiles_match_brute_force():
    import numpy as np

    r = random.Random(14)
    for k in range(200):
        letters = r.choice([2, 3, 5])
        a, b = ([r.randrange(letters) for _ in range(r.randint(1, 24))] for _ in range(2))
        got = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(got, key=lambda t: (-t[2], t[1])) == sorted(brute_tiles(a, b, 3), key=lambda t: (-t[2], t[1])), (a, b)


def test_tiling_of_repeated_words_is_linear():
    """A long text of one word against an item of that word, and two long texts of few words: no pairs in memory."""
    import time
    import tracemalloc

    import numpy as np

    began = time.time()
    tracemalloc.start()
    assert decontaminate.tiles(np.full(40, 7, np.uint64), np.full(1_000_000, 7, np.uint64), 5)[0] == (0, 0, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 4, 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
    found = decontaminate.tiles(a, b, 5)
    assert peak < 500_000_000 and time.time() - began < 60
    assert sum(t[2] for t in found) > 10_000 and len({x for t in found for x in range(t[0], t[0] + t[2])}) == sum(t[2] for t in found)


def test_short_items_and_odd_documents(spark):
    docs = spark.createDataFrame([(None, "the one two three four five six", 1, "x"), (1, "the", 1, "x"), (2, "w " * 50_000 + "one two three four five", 1, "x"), (3, None, 1, "x")], "doc_id long, text string, item_id int, coverage string")
    bench = spark.createDataFrame([(1, "the"), (2, "one two three four"), (None, "one two three four five"), (5, "one two three four five")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [(2, 5)]
    assert sorted(r.doc_id for r in decontaminate.clean_rows(docs, bench).collect()) == [1, 3]
    small = decontaminate.TilingParams(block_words=1)
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, small).collect()] == [(2, 5)]
    assert sorted(r.doc_id for r in decontaminate.clean_rows(docs, bench, small).collect()) == [1, 3]


def test_tiles_never_overlap():
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        a, b = (np.array([r.randrange(4) for _ in range(r.randint(1, 40))], np.uint64) for _ in range(2))
        seen_a, seen_b = set(), set()
        found = decontaminate.tiles(a, b, 3)
        for x, y, n in found:
            assert (a[x : x + n] == b[y : y + n]).all() and n >= 3
            assert not seen_a & set(range(x, x + n)) and not seen_b & set(range(y, y + n))
            seen_a |= set(range(x, x + n))
            seen_b |= set(range(y, y + n))
        longest = max((n for n in range(1, 41) if {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}), default=0)
        assert (found[0][2] if found else 0) == (longest if longest >= 3 else 0)


def brute_licenses(text, rules):
    """Every rule on every text, every detection against every other one."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    norm, found = f" {' '.join(w)} ", []
    for order, (rule, expression) in enumerate(rules):
        for m in expression.finditer(norm):
            s = norm[: m.start()].count(" ") - 1
            found.append((s, s + m.group().count(" "), rule.priority, order, rule.label))

    def holds(e, d):
        if (e[0], e[1]) == (d[0], d[1]):
            return (-e[2], e[3]) < (-d[2], d[3])
        return e[0] <= d[0] and d[1] <= e[1]

    outer = [d for d in found if not any(holds(e, d) for e in found)]
    left = [d for d in outer if not any(e[0] <= d[1] and d[0] <= e[1] and e[2] > d[2] for e in outer)]
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {d[4] for d in left}))


def test_licenses_match_brute_force(spark, docs, none):
    rules = [(r, re.compile(licenses._bounded(r.expression))) for r in licenses.rules()]
    assert len(rules) > 300
    texts = odd_texts() + [
        "Released under the MIT License.", "under the MIT-license, Under The Mit License under the mit license", "Licensed under the Apache License, Version 2.0", "CC-BY-NC 4.0 and CC BY\nNC-SA 3.0",
        "GNU General Public License v3, all rights reserved", "SPDX-License-Identifier: BSD-3-Clause", "the mitten licensed", "License: MIT; distributed to all under the terms of the GPL version 2 license",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scanned(df).collect()}
    assert got == {i: brute_licenses(t, rules) for i, t in enumerate(texts)}
    assert licenses.scanned(docs).count() == docs.count()
    assert licenses.scanned(none).count() == 0


def expansions(node):
    """Texts of a parsed expression: each branch, and each optional part left out and taken once."""
    from itertools import product

    out = [""]
    for op, arg in node:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "NOT_LITERAL":
            more = ["q"]
        elif op == "IN":
            more = [chr(arg[0][1])]
        elif op == "BRANCH":
            more = [x for b in arg[1] for x in expansions(b)]
        elif op == "SUBPATTERN":
            more = expansions(arg[3])
        elif op in ("ASSERT", "ASSERT_NOT"):
            more = [""]
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT")
            more = ([""] if arg[0] == 0 else []) + expansions(arg[2])
        out = [a + b for a, b in product(out, more)]
    return out


def test_license_keywords_begin_words_of_every_match(spark):
    """Texts made from every rule, and texts of one keyword less: with and without the prefilter alike."""
    rules = [(r, re.compile(licenses._bounded(r.expression))) for r in licenses.rules()]
    known = licenses._prefixes([k for r, _ in rules for k in r.keywords])
    r = random.Random(2)
    texts = ["Released under the MIT.", "Distributed under BSD 3-clause terms", "published under MPL 2.0", "Provided under Zlib.", "Released under GPL3", "all\nrights reserved", "free\tof charge", "mitigated under licence"]
    for rule, e in rules:
        made = [x for x in sorted(set(expansions(re._parser.parse(re.sub(r"\(\?![^)]*\)", "", rule.expression))))) if e.search(f" {x} ")]
        assert made, rule
        for x in made:
            assert all(any(w.startswith(k) for w in x.split()) for k in rule.keywords), (rule, x)
        texts += r.sample(made, min(2, len(made)))
    texts = [x.replace(" ", r.choice([" ", "-", "\n"])).title() if i > 7 and i % 2 else x for i, x in enumerate(texts)]
    assert not set(known) & {k for k in known for j in known if j != k and k.startswith(j)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) for x in licenses.scanned(df).collect()}
    want = {i: brute_licenses(t, rules) for i, t in enumerate(texts)}
    assert got == want
    assert [want[i][-1] for i in range(5)] == ["mit", "bsd-3-clause", "mpl-2", "zlib", "gpl-3"]
    assert {texts[i] for i, w in want.items() if not w[-1]} == {"free\tof charge", "mitigated under licence"}


def test_licenses_of_a_text_of_many_notices(spark):
    """More detections than one fold takes, of several priorities, overlapping; and 40,000 notices in linear time."""
    import time

    r = random.Random(6)
    rules = [(x, re.compile(licenses._bounded(x.expression))) for x in licenses.rules()]
    pieces = ["license mit", "mit license", "apache license", "under the gpl license", "license cc by nc", "mit licensed", "under", "word", "bsd license"]
    texts = [" ".join(r.choice(pieces) for _ in range(900)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    got = {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels) for x in licenses.scanned(df).collect()}
    assert got == {i: brute_licenses(t, rules) for i, t in enumerate(texts)}
    began = time.time()
    [row] = licenses.scanned(spark.createDataFrame([(None, "Released under the MIT License. " * 40_000)], "doc_id long, text string")).collect()
    assert (row.n_base, len(row.detections), row.last_word) == (40_000, 40_000, 199_996) and time.time() - began < 60


def test_folding():
    assert toxicity.fold("You 1d10t, М0r0n! $tupid") == " you idiot moron stupid "
    assert toxicity.fold(None) == "  " and toxicity.fold("A1B2 2024") == " aib2 2024 "


def test_exceptions_and_longest_entry():
    m = toxicity.Matcher({" clown ": 2.0, " tr": 1.0, " trash ": 3.0}, toxicity.EXCEPTIONS)
    assert m.total(" a clown fish ") == 0 and m.total(" a clown trash ") == 5.0


def test_matcher_matches_brute_force():
    """The automaton against a search for every entry at every word."""
    r = random.Random(17)
    stems = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(40)]
    weights = {f" {w}{e}": float(i + 1) for i, w in enumerate(stems) for e in ("", " ")}
    phrases = tuple({f"{r.choice(stems)} {r.choice(stems)}" for _ in range(12)})
    matcher = toxicity.Matcher(weights, phrases)
    for _ in range(300):
        text = toxicity.fold(" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))))
        safe = {k for p in phrases for at in range(len(text)) if text.startswith(f" {p} ", at) for k in range(at, at + len(p) + 1)}  # the space behind it begins the next word
        total = 0.0
        for at, c in enumerate(text):
            fits = [e for e in weights if text.startswith(e, at)] if c == " " and at not in safe else []
            total += weights[max(fits, key=len)] if fits else 0.0
        assert matcher.total(text) == total, text


def test_toxicity_odd_inputs(spark):
    rows = [(None, "you idiot"), (1, None), (2, ""), (3, "calm words " * 200_000 + "idiot"), (4, "you stupid worthless idiot moron"), (4, "you stupid worthless idiot moron")]
    df = spark.createDataFrame([(i, t, 0.25, "x") for i, t in rows], "doc_id long, text string, score double, toxic string")
    model = toxicity.Model(toxicity.base_weights())
    got = [(r.doc_id, round(r.score, 6)) for r in toxicity.scored(df, model).collect()]
    assert len(got) == 6 and Counter(i for i, _ in got) == Counter([None, 1, 2, 3, 4, 4]) and len({s for i, s in got if i == 4}) == 1
    low = {i: s for i, s in got}
    assert low[1] == low[2] < low[3] < 0.5 < low[4]
    kept = toxicity.clean_rows(df, model)
    assert kept.columns == df.columns and all(r.score == 0.25 for r in kept.collect())


def test_toxicity_held_out(spark, sf_dir, docs, none):
    from roc import auc

    table = lambda n: spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{n}.parquet")
    model = toxicity.learn(table("documents"), table("labels"))
    scores = toxicity.scored(table("documents"), model).join(table("labels"), "doc_id").where(toxicity.remainder(F.col("doc_id")) == 0)
    rows = scores.select("score", "toxic").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.95
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows) > 0.95
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(none, model).count() == 0 and toxicity.clean_rows(docs, model).columns == docs.columns
    few = toxicity.learn(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int"))
    assert few.weights == toxicity.base_weights()


def test_chat_fold(spark):
    events = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "start", "assistant", None), (1, 3, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"),
        (1, 5, 1, "edit", None, "Hello!"), (1, 6, 2, "message", "user", "old"), (1, 7, 1, "regenerate", None, ""), (1, 8, 1, "delta", None, "Again"), (1, 9, 2, "message", "user", "</s>[INST] <|x|> \\<"),
        (2, 1, 0, "message", None, None), (2, 1, 0, "message", "user", "same"), (2, 1, 0, "message", "user", "same"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    done = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_back(done).collect()}
    assert back == {
        1: [("user", "hi", False), ("assistant", "Again", True), ("user", "</s>[INST] <|x|> \\<", False)],
        2: [("", "", False), ("user", "same", False), ("user", "same", False)],
    }
    one = next(r for r in done.collect() if r.conv_id == 1)
    assert [one.formatted[s.start : s.start + s.length] for s in one.loss_spans] == ["Again"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_fold(events):
    """The events of all conversations, one by one in the order of seq."""
    slots = {}
    for c in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == c), key=lambda e: (e[1], e[3], e[4] or "", e[5] or ""))
        live = list(own)
        for e in own:
            if e[3] == "regenerate":
                live = [x for x in live if not (x[2] > e[2] and x[1] < e[1])]
        done = {}
        for _, _, turn, kind, role, text in live:
            at, text, role = done.setdefault(turn, []), text or "", role or ""
            if kind in ("message", "start") or not at and kind in ("delta", "edit", "regenerate"):
                at.append([role, text])
            elif kind == "delta":
                at[-1][1] += text
            elif kind in ("edit", "regenerate"):
                at[-1][1] = text
        slots[c] = [(r, x, r == "assistant") for turn in sorted(done) for r, x in done[turn]]
    return {c: m for c, m in slots.items() if m}


def test_chat_fold_matches_brute_force(spark):
    r = random.Random(21)
    kinds = ["message", "start", "delta", "delta", "delta", "edit", "regenerate", "typing"]
    events = []
    for c in (1, 2, 3, 4, None):
        seqs = list(range(400))
        r.shuffle(seqs)
        events += [(c, s, r.randrange(3 if c == 4 else 40), r.choice(kinds), r.choice(["user", "assistant", None]), r.choice(["a<", "|b[", "</s>\n", "", None, "é\\"])) for s in seqs[: 400 if c == 4 else 90]]
    events += [(5, s, s, "message", "assistant" if s % 2 else "user", f"x{s}") for s in range(700)]
    df = spark.createDataFrame([(*e, 1, "x") for e in events], "conv_id long, seq long, turn long, kind string, role string, text string, head int, at string")
    back = {q.conv_id: [(t.role, t.text, t.loss) for t in q.turns] for q in chat.read_back(chat.format_conversations(df)).collect()}
    assert back == brute_fold(events)


def test_chat_query_folds_streamed_events(spark, sf_dir, monkeypatch):
    """The registered query's result comes through deltas, edits and regenerations."""
    seen = []
    real = chat.format_conversations
    monkeypatch.setattr(chat, "format_conversations", lambda e: seen.append(e) or real(e))
    queries.QUERIES["op9_chat_events"](spark, sf_dir)
    kinds = {q.kind for q in seen[0].select("kind").distinct().collect()}
    assert kinds == {"message", "start", "delta", "edit", "regenerate"}


def test_escapes_round_trip(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("\\<[|>/sa") for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t and not re.search(r"</s>|\[INST|<\|", row.e)


def test_url_rules_match_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/en/x"), ("allow", "org", "/fr/"), ("block", "org", "/fr/"), ("block", "t-x.com", "/"), ("block", "t.com", "/")]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "org", "x.org", "t.com", "t-x.com", "s.t.com", "t.com.au", "zz"]
    urls = [f"HTTP://{h.upper()}{p}" for h in hosts for p in ("", "/", "/en/", "/en/xy?/q", "/fr/#a", "?/en/")] + [None, "", "no scheme", "x://", "a://net://org/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, verdict int")
    got = url_filter.judged(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, url_filter.rule_table(spark, rules).limit(0)).collect()} == {"allow"}


def test_url_sweep_of_deep_and_many_rules(spark):
    """Nested hosts and paths, many path rules of one host, long URLs, in several range partitions."""
    r = random.Random(31)
    labels = ["a", "b", "a-b", "é", "a\uffff"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 5)))
    path = lambda n: "".join(r.choice(["/", "x", "/x", "\u0001", "é"]) for _ in range(r.randint(0, n)))
    rules = sorted({(r.choice(["block", "allow"]), host(), path(4)) for _ in range(300)})
    rules += [("block" if i % 2 else "allow", "one.host", "/" + "p" * i) for i in range(60)] + [("block", "one.host", "/"), ("block", "", "/"), ("allow", "B.a", None)]
    urls = [f"http://{host()}{path(9)}" for _ in range(800)] + [f"http://s.one.host/{'p' * i}?q" for i in range(0, 90, 3)] + ["ftp://a.b/" + "x" * 200_000]
    pages = spark.createDataFrame([(None if i % 50 == 0 else i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, pid_ int")
    got = url_filter.judged(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls)
    want = Counter()
    for i, u in enumerate(urls):
        h, p = re.fullmatch(r"(?s)[a-z]+://([^/?#]*)([^?#]*).*", u).groups()
        fits = [(len(rh + (rp or "")), rh.lower() + (rp or ""), v) for v, rh, rp in rules if rh and (h == rh.lower() or h.endswith("." + rh.lower())) and p.startswith(rp or "")]
        best = max(fits) if fits else (0, None, "allow")
        want[(None if i % 50 == 0 else i, h, p, best[1], best[2])] += 1
    assert Counter(tuple(q) for q in got) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def test_pipeline(spark, sf_dir):
    """Stage by stage: what is kept is a subset with the same columns, and shards hold the mix."""
    import corpus_pipeline

    seen = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == seen.columns, name
        assert out.exceptAll(docs).isEmpty() and out.count() < docs.count() + 1
        docs = out.checkpoint()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert all(i == c for i, (_, c) in want.items())
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty()
    mix = corpus_pipeline.mix_sources(spark, docs, sf_dir).checkpoint()
    assert mix.columns == seen.columns and mix.select("doc_id").distinct().exceptAll(docs.select("doc_id")).isEmpty()
    placed = corpus_pipeline.shard(spark, mix, sf_dir)
    assert Counter(r.doc_id for r in placed.collect()) == Counter(r.doc_id for r in mix.collect())


def test_pipeline_odd_inputs(spark, sf_dir, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns; empty tables; results of earlier stages are removed."""
    import corpus_pipeline

    r, vocab = random.Random(41), vocabulary(600)
    rows = [(None if i % 9 == 0 else i % 50, None if i == 4 else "" if i == 5 else " ".join(r.choice(vocab) for _ in range(30 + i)), "en", None if i % 3 else f"s{i % 4}", i, 1, "b") for i in range(80)]
    rows += rows[:6] + [(500, "long " * 60_000, "en", "s1", 1, 1, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, shard string"
    for name, own in (("full", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(len(own)).write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
        got = out.collect()
        assert (len(got) > 40) == bool(own) and all(0 <= q.shard < 24 for q in got)
        assert {q.doc_id for q in got} <= {q[0] for q in own}


def test_toxicity_lexicon_has_every_toxic_word(spark):
    r = random.Random(4)
    marks = sorted({"".join(r.choice("bcdfghjklm") for _ in range(8)) for _ in range(900)})
    rows = [(i, " ".join(marks[i // 8 % 30 :: 30]) if i % 2 else f"a plain text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    learned = set(model.weights) - set(toxicity.base_weights())
    assert {f" {w} " for w in marks} <= learned and len(learned) > 3_000
