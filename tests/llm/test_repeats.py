"""Suffix dedup and relative parsing against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from yieldgate.llm import blocks, relative, suffix


def brute(rows, n, items):
    """For each row which items lie in a window that starts in a smaller document too."""
    first: dict = {}
    for i, t in rows:
        x = items(t or "")
        for k in range(len(x) - n + 1):
            if i is not None:
                w = bytes(x[k : k + n]) if items is as_bytes else tuple(x[k : k + n])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        x = items(t or "")
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if i is not None and first[bytes(x[k : k + n]) if items is as_bytes else tuple(x[k : k + n])] < i:
                gone[k : k + n] = True
        out.append((i, x, gone))
    return out


def as_bytes(t):
    return t.encode()


def as_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def want_bytes(rows, n):
    out = []
    for i, x, gone in brute(rows, n, as_bytes):
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def want_words(rows, n):
    out = [(i, len(x), int(gone.sum()), hashlib.sha256(" ".join(w for w, g in zip(x, gone, strict=True) if not g).encode()).hexdigest()) for i, x, gone in brute(rows, n, as_words)]
    return sorted(out, key=str)


def small(seed, kinds="ab", n=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(kinds, k=rng.randint(0, 30))) for _ in range(6)]
    return [(rng.randint(0, 25), " ".join(rng.choices(pool, k=rng.randint(0, 4)))) for _ in range(n)]


@pytest.mark.parametrize("n", [4, 6, 20, 50])
def test_difference_cover(spark, n):
    """Strings at all positions modulo 3, dealt over several ranges, with runs that end anywhere."""
    rng = random.Random(n)
    pool = ["".join(rng.choices("ab", k=3 * n)) for _ in range(4)]
    runs = []
    for doc in range(60):
        x = rng.choice(pool)
        a = rng.randint(0, n)
        runs.append((doc // 2, rng.randint(0, 50), x[a : a + rng.randint(n, 2 * n)].encode()))
    df = spark.createDataFrame(runs, "doc_id long, lo int, body binary").repartition(5)
    got = set()
    for r in suffix.repeated_strings(df, n, 7).collect():
        got |= {(r["doc_id"], r["lo"] + k) for k in range(r["many"])}
    first, want = {}, set()
    for doc, _, body in runs:
        for k in range(len(body) - n + 1):
            first[body[k : k + n]] = min(doc, first.get(body[k : k + n], doc))
    for doc, lo, body in runs:
        want |= {(doc, lo + k) for k in range(len(body) - n + 1) if first[body[k : k + n]] < doc}
    assert got == want and want


def test_a_triple_that_many_tasks_share(spark):
    runs = [(d, 0, b"x" * 30) for d in range(3000)]
    df = spark.createDataFrame(runs, "doc_id long, lo int, body binary").repartition(9)
    got = {(r["doc_id"], r["lo"] + k) for r in suffix.repeated_strings(df, 20, 4).collect() for k in range(r["many"])}
    assert got == {(d, k) for d in range(1, 3000) for k in range(11)}


@pytest.mark.parametrize(("rows", "most"), [(1, 3), (4, 6), (4, 1000), (100, 2)])
def test_whole_groups(rows, most):
    rng = random.Random(rows)
    keys = sorted(rng.choices(range(12), k=80)) + [20] * 30 + [21]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7]), pa.array(range(a, min(a + 7, len(keys))))], names=["k", "v"]) for a in range(0, len(keys), 7)]
    got = [(t.column(0).to_pylist(), t.column(1).to_pylist(), c) for t, c in blocks.whole_groups(iter(batches), rows, most)]
    assert [v for _, vs, _ in got for v in vs] == list(range(len(keys)))
    for k in set(keys):
        at = [(ks.count(k), c) for ks, _, c in got if k in ks]
        assert len(at) == 1 or all(c for _, c in at) and keys.count(k) > most
    assert all(len(set(ks)) == 1 for ks, _, c in got if c)


def test_a_crowded_anchor_is_contested(monkeypatch):
    rng = random.Random(2)
    lines = sorted((7, rng.randint(0, 9) << 32 | rng.randint(0, 3), rng.randint(0, 5), rng.randint(0, 40), k << blocks._SHIFT | 3) for k in range(400))
    columns = [pa.array(c, pa.int64()) for c in zip(*lines, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["group", "anchor", "contents", "doc_id", "place"])
    def run():
        out = pa.Table.from_batches(list(blocks._compare(iter([batch.slice(a, 50) for a in range(0, 400, 50)])))).to_pylist()
        return {(r["doc_id"], r["lo"]) for r in out if r["kind"] == blocks._COPIED}, {(r["doc_id"], r["lo"]): r["key"] for r in out if r["kind"] == blocks._CONTESTED}
    copied, contested = run()
    monkeypatch.setattr(blocks, "HELD", 20)
    monkeypatch.setattr(blocks, "AT_ONCE", 30)
    same, more = run()
    assert same == copied and set(contested) <= set(more) and set(more.values()) == {None}


@pytest.mark.parametrize("seed", range(4))
def test_factors(seed):
    rng = random.Random(seed)
    reference, window = relative.Reference(3), 3
    texts = [rng.choices([b"a", b"b"], k=rng.randint(0, 12)) for _ in range(6)]
    for t in texts[:-1]:
        reference.add(t)
    words, held = texts[-1] * 2, {tuple(t[k : k + 3]) for t in texts[:-1] for k in range(len(t) - 2)}
    found = list(reference.factors(words))
    covered = {at + k for at, length in found for k in range(length - window + 1)}
    assert covered == {k for k in range(len(words) - 2) if tuple(words[k : k + 3]) in held}
    for (a, n), (b, _) in zip(found, found[1:], strict=False):
        assert b > a + n - window
    def occurs(at, n):
        return any(t[k : k + n] == words[at : at + n] for t in texts[:-1] for k in range(len(t) - n + 1))

    for at, n in found:
        assert occurs(at, n) and not (at + n < len(words) and occurs(at, n + 1))  # the longest


def test_the_longest_place_counts():
    words = [b"w%d" % k for k in range(40)]
    reference = relative.Reference()
    reference.add([*words[:14], b"zz"])
    reference.add(words[:30])
    assert list(reference.factors(words)) == [(0, 30)]


def test_a_hot_window_takes_no_room():
    words = [b"w%d" % k for k in range(20)]
    reference = relative.Reference()
    reference.add(words)
    states = len(reference.moves)
    for k in range(20000):
        reference.add(words[k % 8 : 13 + k % 8])
    assert len(reference.moves) == states and len(reference.letters) == 8


def test_one_passage_in_thousands_of_documents(spark):
    """Most of them meet it in other chunks and tasks than the least one."""
    rng = random.Random(5)
    passage = " ".join(f"licence{k}" for k in range(13))
    rows = [(i, f"{rng.random()} {rng.random()} {passage} {rng.random()} tail") for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    assert sorted(map(tuple, relative.relative_digest(df).collect()), key=str) == want_words(rows, 13)
    got = suffix.suffix_digest(df).select("doc_id", "n_bytes", "n_removed").collect()
    assert {r["n_removed"] == 0 for r in got if r["doc_id"] == 0} == {True} and {r["n_removed"] >= len(passage) for r in got if r["doc_id"] > 0} == {True}


def test_many_repeated_windows_on_one_partition(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(20_000))
    rows = [(1, long), (2, "x " + long), (3, "a" * 70_000), (4, "a" * 70_000 + "b")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, relative.relative_digest(df).collect()), key=str) == want_words(rows, 13)
        assert sorted(map(tuple, suffix.suffix_digest(df).collect()), key=str) == want_bytes(rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_words_that_fool_polynomial_hashes():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    data, offsets = blocks.raw_text(pa.array([f"{a} {b} {a}"]))
    starts, ends, _ = blocks.words_of(data, offsets)
    h = blocks.word_hashes(data, starts, ends)
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize(("n", "hot"), [(5, False), (12, True), (50, False)])
def test_suffix_digest(spark, docs, rows, n, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(blocks, "frequent_anchors", _all_anchors)
    got = sorted(map(tuple, suffix.suffix_digest(docs, n).collect()), key=str)
    assert got == want_bytes(rows, n)


def _all_anchors(anchors, parts):
    return [r["anchor"] for r in anchors.collect()]


@pytest.mark.parametrize(("n", "hot"), [(3, True), (13, False)])
def test_relative_digest(spark, docs, rows, n, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(blocks, "frequent_anchors", _all_anchors)
    got = sorted(map(tuple, relative.relative_digest(docs, n).collect()), key=str)
    assert got == want_words(rows, n)


def test_random_tables(spark):
    for seed in range(2):
        rows = list({i: (i, t) for i, t in small(seed)}.values())
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, suffix.suffix_digest(df, 6).collect()), key=str) == want_bytes(rows, 6)
        rows = [(i, t.replace("a", "a ").replace("b", "b ")) for i, t in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, relative.relative_digest(df, 4).collect()), key=str) == want_words(rows, 4)


def test_long_rows_are_cut_alike(monkeypatch):
    rng = np.random.default_rng(1)
    values = blocks._BYTES[rng.integers(97, 100, 5000)]
    offsets = np.array([0, 10, 10, 4000, 5000])
    shape = suffix.shape(50)
    whole = blocks.cut(values, offsets, shape)
    monkeypatch.setattr(blocks, "_LOW", np.uint64(9))
    parts = blocks._cut_long(values, offsets, shape)
    same = [(r, a, n) for r, a, n in zip(*(x.tolist() for x in whole[:3]), strict=True)]
    # With fewer bits left for places, anchors differ; windows are covered once all the same.
    def windows(rows):
        return sorted((r, a + k) for r, a, n in rows for k in range(n))
    assert windows([(r, a, n) for r, a, n in zip(*(x.tolist() for x in parts[:3]), strict=True)]) == windows(same)


def test_columns_stay(docs, rows, empty):
    out = suffix.remove_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[6] is None and kept[4] == "" and kept[0] == rows[0][1]
    assert suffix.remove_repeats(empty).count() == 0
    assert suffix.suffix_digest(empty).count() == relative.relative_digest(empty).count() == 0


def test_versions_of_one_id(spark):
    df = spark.createDataFrame([(1, "x" * 80), (2, "x" * 80), (2, "y" * 10), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix.suffix_digest(df).collect()}
    assert got == {(1, 80): 0, (2, 80): 80, (2, 10): 10, (2, 0): 0}
