from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from yieldgate.llm import pseudo
from yieldgate.llm.common import documents


def corpus(n: int, seed: int) -> list[tuple[int, str]]:
    """A language where a word mostly tells the next one."""
    rng = random.Random(seed)
    follow = {f"w{k}": f"w{(7 * k + 3) % 40}" for k in range(40)}
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(40)}"]
        for _ in range(60):
            w.append(follow[w[-1]] if rng.random() < 0.8 else f"w{rng.randrange(40)}")
        out.append((i, " ".join(w)))
    return out


def test_learns_from_both_sides(spark):
    docs = documents(spark.createDataFrame(corpus(400, 1), "doc_id long, text string").repartition(2))
    model = pseudo.train(docs, rounds=3)
    held = documents(spark.createDataFrame(corpus(50, 2), "doc_id long, text string"))
    mean = np.mean([r["mean_log_prob"] for r in pseudo.score(held, model).collect()])
    alone = pseudo.Network.of(model.weights)
    alone.tables[:] = 0
    blind = np.mean([r["mean_log_prob"] for r in pseudo.score(held, pseudo.Model(model.top, alone.flat())).collect()])
    assert mean > blind + 1.0
    shuffled = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in corpus(50, 2)]
    worse = np.mean([r["mean_log_prob"] for r in pseudo.score(documents(spark.createDataFrame(shuffled, "doc_id long, text string")), model).collect()])
    assert mean > worse + 0.5


def test_scores_are_the_formula(docs, rows, empty):
    model = pseudo.train(documents(docs))
    net, tokens = pseudo.Network.of(model.weights), pseudo.Tokens(model.top)
    got = {(r["doc_id"], r["n_tokens"]): r for r in pseudo.score(documents(docs), model).collect()}
    for i, t in rows:
        ids = tokens.of(pa.array((t or "").lower().split(), pa.string())).tolist()
        total = 0.0
        padded = [0, 0, *ids, 0, 0]
        for k, token in enumerate(ids[:300] if len(ids) > 300 else ids):
            seen = padded[k : k + 2] + padded[k + 3 : k + 5]
            z = np.tanh(sum(net.tables[p, x] for p, x in enumerate(seen))) @ net.out + net.bias
            total += z[pseudo.classes(model.top)[token]] - np.log(np.exp(z).sum())
        r = got[(i, len(ids))]
        if len(ids) <= 300:
            assert abs(r["log_prob"] - total) < 1e-3 * max(1, len(ids))
        assert (r["mean_log_prob"] is None) == (not ids)
    assert pseudo.pseudo_likelihood(empty).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    net = pseudo.Network.start(np.zeros(pseudo.SIZE))
    seen, token = rng.integers(0, pseudo.TOKENS, (64, 4)), rng.integers(1, pseudo.SIZE, 64)
    before = net.log_probs(seen, token).mean()
    for _ in range(30):
        net.learn(seen, token, 0.5)
    assert net.log_probs(seen, token).mean() > before + 0.5


def test_large_logits_stay_finite():
    rng = np.random.default_rng(0)
    net = pseudo.Network.start(np.zeros(pseudo.SIZE))
    seen, goal = rng.integers(0, pseudo.TOKENS, (64, 4)), rng.integers(1, pseudo.SIZE, 64)
    near = net.log_probs(seen, goal)
    net.bias += 900
    assert np.abs(net.log_probs(seen, goal) - near).max() < 1e-3
    net.learn(seen, goal, 0.5)
    assert np.isfinite(net.flat()).all() and net.log_probs(seen, goal).mean() > near.mean()


def test_words_are_counted_once(spark, docs, rows):
    got = {r["word"]: r["n"] for r in pseudo.word_counts(documents(docs)).collect()}
    want: dict[str, int] = {}
    for _, t in rows:
        for w in (t or "").lower().split():
            want[w] = want.get(w, 0) + 1
    assert got == want


def test_rare_and_unseen_words_are_told_apart(spark):
    """At production settings: words of one bucket have the shares that the whole corpus gives them."""
    same = [w for w in (f"rare{k}" for k in range(9000)) if zlib.crc32(w.encode()) % pseudo.SEEN_BUCKETS == 7][:3]
    often, once, never = same
    text = [t for _, t in corpus(300, 4)]
    filler = " ".join(f"fill{k} fill{k}" for k in range(pseudo.SEEN))  # so that the words in question are not frequent
    text += [filler] * 20 + [f"w1 {often} w2"] * 20 + [f"w1 {once} w2"]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["log_prob"] for r in pseudo.pseudo_likelihood(df).collect()}
    n = len(text)
    assert len({got[i] for i in range(n - 21, n - 1)}) == 1
    assert abs(got[n - 2] - got[n - 1] - np.log(20.5 / 1.5)) < 1e-3

    docs = documents(df)
    counts, model = pseudo.word_counts(docs), pseudo.train(docs)
    assert not {often, once} & set(model.top)
    held = spark.createDataFrame([(k, f"w1 {w} w2") for k, w in enumerate(same)], "doc_id long, text string")
    a, b, c = (r["log_prob"] for r in pseudo.score_words(documents(held), counts, model).orderBy("doc_id").collect())
    assert a > b + 1 and b > c + 1
    classes = {r["log_prob"] for r in pseudo.score(documents(held), model).collect()}
    assert max(classes) - min(classes) < 1e-6


def test_shares_of_a_bucket_are_one(spark):
    counts = spark.createDataFrame([(f"v{k}", k % 5 + 1) for k in range(400)], "word string, n long")
    mine = [k for k in range(400) if zlib.crc32(f"v{k}".encode()) % pseudo.BUCKETS == 3]
    rows = [(k, k, b"", [f"v{k}"], [1]) for k in mine] + [(-1, -1, b"", [next(w for w in (f"x{k}" for k in range(999)) if zlib.crc32(w.encode()) % pseudo.BUCKETS == 3)], [1])]
    codes = spark.createDataFrame(rows, "row long, doc_id long, tokens binary, words array<string>, times array<long>")
    got = {r["row"]: np.exp(r["share"]) for r in pseudo.shares(codes, counts, []).collect()}
    assert abs(sum(got[k] for k in mine) + len(mine) * got[-1] - 1) < 1e-6


def test_production_rounds_learn_from_both_sides(spark):
    docs = documents(spark.createDataFrame(corpus(400, 1), "doc_id long, text string").repartition(2))
    counts, model = pseudo.word_counts(docs), pseudo.train(docs)
    held = corpus(50, 2)
    mixed = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in held]
    a, b = (np.mean([r["mean_log_prob"] for r in pseudo.score_words(documents(spark.createDataFrame(x, "doc_id long, text string")), counts, model).collect()]) for x in (held, mixed))
    assert a > b + 0.5


def test_hashes_of_words_are_crc32():
    words = ["", "a", "é漢字", "x" * pseudo.LONG_WORD, "y" * (pseudo.LONG_WORD + 1), "z" * 5000, "", "word"]
    want = [zlib.crc32(w.encode()) for w in words]
    assert pseudo.crc32(pa.array(words)).tolist() == want
    assert pseudo.crc32(pa.array(["other", *words]).slice(1)).tolist() == want
    assert pseudo.crc32(pa.array([], pa.string())).tolist() == []


def test_words_are_those_of_str_split():
    texts = [" \t two  words\n", "", "\u3000ÄÖ\x0bİx\u00a0y\x85z\x1cq ", "one"]
    words, row = pseudo.split(pa.array(texts))
    assert list(zip(row.tolist(), words.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    assert not len(pseudo.split(pa.array([], pa.string()))[0])


def test_a_step_moves_every_weight_by_its_gradient():
    """Against differences of the loss, for batches that do and do not fall into blocks."""
    rng = np.random.default_rng(1)
    for n in (64, 61):
        net = pseudo.Network.start(np.zeros(pseudo.SIZE))
        seen, goal = rng.integers(0, 6, (n, 4)), rng.integers(1, pseudo.SIZE, n)
        before = pseudo.Network.of(net.flat())
        net.learn(seen, goal, 1.0)

        def loss(place, token, unit, by, before=before, seen=seen, goal=goal):
            moved = pseudo.Network.of(before.flat().astype(np.float64))
            moved.tables[place, token, unit] += by
            return -moved.log_probs(seen, goal).mean()

        for place, token, unit in ((0, 3, 2), (1, 0, 15), (2, 5, 7), (3, 1, 0)):
            slope = (loss(place, token, unit, 1e-2) - loss(place, token, unit, -1e-2)) / 2e-2
            step = net.tables[place, token, unit] - before.tables[place, token, unit]
            assert abs(step + n**0.5 * slope) < 2e-3 * max(1, abs(step) * 10)
        assert (net.tables[:, 6:] == before.tables[:, 6:]).all()
