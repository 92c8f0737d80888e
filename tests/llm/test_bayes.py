from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from yieldgate.llm import bayes
from yieldgate.llm.components import components


def grams(t: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(rows) -> dict:
    """(doc_id, text) -> set_id, class_id, n_links."""
    first: dict = {}
    for i, t in rows:
        if grams(t) and i is not None:
            first[grams(t)] = min(i, first.get(grams(t), i))
    sets = list(first)
    near = {a: [b for b in sets if a is not b and 5 * len(a & b) >= 4 * len(a | b)] for a in sets}
    group: dict = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        group[a] = min(first[x] for x in seen)
    out = {}
    for i, t in rows:
        g = grams(t)
        out[(i, t)] = (first[g], group[g], len(near[g])) if g and i is not None else (i, i, 0)
    return out


def crowd(n: int = 60) -> list[tuple[int, str]]:
    """Copies of one text with a few words changed each, exact copies, and texts that share half of it."""
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        if i % 4 == 3:
            w = w[:75] + [f"y{rng.randint(0, 10**6)}" for _ in range(75)]
        out.append((1000 + i, " ".join(w)))
    return out


def check(df, rows):
    want = brute(rows)
    got = sorted(map(tuple, bayes.near_duplicates(df).select("doc_id", "set_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted([(i, *want[(i, t)]) for i, t in rows], key=str)


def test_join(docs, rows):
    check(docs, rows)


def test_blocks_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(bayes, "GROUP_BLOCK", 8)
    monkeypatch.setattr(bayes, "CLUSTER_BLOCK", 7)
    rows = crowd()
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_keep_one(docs, rows, empty):
    want = brute(rows)
    kept = bayes.keep_one(docs)
    assert kept.schema == docs.schema
    got = sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()]))
    assert got == sorted({str(r) for r in rows if want[r][1] == r[0]})
    assert bayes.keep_one(empty).count() == 0 and bayes.near_duplicates(empty).count() == 0


def test_versions_of_one_document(spark):
    """Both versions find their links, and all that they are tied to is one class; an unrelated repeat moves no row."""
    rng = random.Random(8)
    a, b = (" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(80)) for _ in range(2))
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (5, near(b)), (7, near(a)), (9, "x y z"), (None, "p q"), (None, "p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in bayes.near_duplicates(df).collect()}
    assert got == {(1, 1, 1), (5, 1, 1), (7, 1, 1), (9, 9, 0), (None, None, 0)}
    assert sorted(str((r["doc_id"], r["text"])) for r in bayes.keep_one(df).collect()) == sorted(map(str, [r for r in rows if r[0] in (1, 9, None)]))
    twice = [*rows, (9, "x y z"), (5, near(b))]
    kept = bayes.keep_one(spark.createDataFrame(twice, "doc_id long, text string"))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(str, [r for r in rows if r[0] in (1, 9, None)]))


def test_a_hub(spark):
    edges = [(k, 0) for k in range(1, 2000)] + [(5000 + k, k) for k in range(1, 50)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == 2049 and {r["component"] for r in got} == {0}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long"), rounds=1)


def test_pruning_is_the_posterior():
    """Against the integral of the posterior density."""
    x = np.linspace(0, 1, 200_001)[1:-1]
    for k, n in enumerate(range(0, bayes.VALUES + 1, bayes.STEP)):
        need = bayes.least_matches()[k]
        for m in (need, need - 1):
            if 0 <= m <= n:
                d = m * np.log(x) + (n - m) * np.log1p(-x)
                d = np.exp(d - d.max())
                assert (d[x >= 0.8].sum() / d.sum() >= bayes.TOLERANCE) == (m >= need)


def test_likely_agrees_with_counts():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 9, bayes.VALUES).astype(np.uint16)
    many = np.where(rng.random((300, bayes.VALUES)) < rng.random((300, 1)), one, 77).astype(np.uint16)
    need, same = bayes.least_matches(), many == one
    want = np.ones(300, bool)
    for k in range(1, len(need)):
        want &= same[:, : k * bayes.STEP].sum(1) >= need[k]
    assert bayes.likely(one, many).tolist() == want.tolist()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(20)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == parent


def test_wanted_documents_are_never_lost(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = spark.range(0, 3000, 50).select(F.col("id").alias("doc"))
    for bits in (64, 1 << 10, bayes.MAP_BITS):
        got = {r["doc_id"] for r in bayes._wanted(docs, ids, bits).collect()}
        assert set(range(0, 3000, 50)) <= got
    assert len(got) < 100
