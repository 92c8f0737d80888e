from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from yieldgate.llm import packing


def used(plan) -> Counter:
    out: Counter[int] = Counter()
    for pattern, times in plan:
        for n, a in pattern.items():
            out[n] += a * times
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_every_piece_has_one_place(histogram):
    plan = packing.plan_patterns(histogram, 64)
    assert used(plan) == Counter(histogram)
    assert all(0 < sum(n * a for n, a in p.items()) <= 64 and t > 0 for p, t in plan)


def test_little_padding():
    rng = np.random.default_rng(0)
    histogram = dict(Counter((rng.lognormal(5.5, 0.8, 20_000).astype(int) % 1023 + 1).tolist()))
    plan = packing.plan_patterns(histogram)
    fill = sum(n * c for n, c in histogram.items())
    size = sum(t * packing.padded(sum(n * a for n, a in p.items())) for p, t in plan)
    assert size <= 1.01 * fill


def test_bound_is_a_bound():
    lengths, demand = np.array([300, 400, 600]), np.array([10.0, 10.0, 10.0])
    program = packing.Program(lengths, demand, 1024)
    bound = program.solve()
    assert bound <= program.cost @ program.x + 1e-9
    cover = np.zeros(3)
    for p, x in zip(program.patterns, program.x, strict=True):
        for k, a in p.items():
            cover[k] += a * x
    assert (cover >= demand - 1e-6).all()


def test_priced_columns_carry_the_plan():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 1023)
    demand = rng.integers(1, 200, len(lengths)).astype(float)
    program = packing.Program(lengths, demand, 1024)
    assert program.plain.all() and program.total() > 1.2 * program.ideal  # nothing but one length a pattern
    program.solve()
    alone = sum(x for p, x in zip(program.patterns, program.x, strict=True) if len(p) == 1)
    assert program.ended == "gap" and program.total() <= 1.002 * program.bound and alone < 0.2 * program.x.sum()
    assert program.entered > 500 and program.plain.sum() < 300


def test_many_lengths_after_a_session(spark):
    spark.range(10).count()
    plan = packing.plan_patterns(dict.fromkeys(range(1, 1023), 10))
    assert used(plan) == Counter(dict.fromkeys(range(1, 1023), 10))


def test_long_white_space(vocab_path):
    library = Tokenizer.from_file(vocab_path)
    for text in (" " * 1_000_000, "x\n" + "\t " * 40_000 + "<|endoftext|> y", "a" * 100_000 + " " * 49_999):
        assert packing.text_ids(text, vocab_path) == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(docs, empty, rows, vocab_path):
    library = Tokenizer.from_file(vocab_path)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    sequences, seen = defaultdict(list), Counter()
    for r in packing.pack_texts(docs, vocab_path).collect():
        whole = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(whole)
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({i: sum(map(len, x)) for i, x in ids.items()})
    assert sorted(sequences) == list(range(len(sequences)))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert packing.pack_texts(empty, vocab_path).count() == 0


def test_a_length_that_most_pieces_share(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0L as start", "if(id % 10 = 0, 700L, 512L) as length")
    got = packing.pack(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000
    assert max(Counter(r["sequence_id"] for r in got).values()) == 2


def test_white_space_below_the_limit_is_looked_at_once(vocab_path):
    import time

    text = "".join(" " * (packing.LONG_SPACE - 1) + "x" for _ in range(4))
    packing.text_ids("warm up", vocab_path)
    began = time.perf_counter()
    assert not packing.has_long_space(text) and packing.has_long_space(text + " " * packing.LONG_SPACE)
    assert time.perf_counter() - began < 0.5
    assert packing.text_ids(text, vocab_path) == Tokenizer.from_file(vocab_path).encode(text, add_special_tokens=False).ids
