from __future__ import annotations

import functools
import hashlib

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from yieldgate.llm import bpe


@functools.cache
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encoded(vocab, text: str, block: int, most: int) -> list[int]:
    segmenter, coder, out = bpe.Segmenter(vocab, most), bpe.Encoder(vocab, 50), []
    for at in range(0, max(1, len(text)), block):
        pieces = segmenter.feed(text[at : at + block], at + block >= len(text))
        coder.learn(p for p in pieces if isinstance(p, str))
        out.append(coder.ids(pieces))
    return np.frombuffer(b"".join(out), "<u4").tolist()


PARTS = st.sampled_from(["ing", "the ", " ", "\n", "'ll", "'", "12", "é", "漢", "!!", "<|endoftext|>", "<|end", "a" * 40, "zq" * 30, "　", "Ünder", "\x1c", "👍"])


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PARTS, max_size=30).map("".join), st.integers(1, 40), st.integers(1, 50))
def test_streamed_tokens_are_the_library_s(vocab_path, text, block, most):
    vocab, library = bpe.vocabulary(vocab_path), _library(vocab_path)
    want = library.encode(text, add_special_tokens=False).ids
    assert encoded(vocab, text, block, most) == want
    decoder = bpe.Decoder(vocab)
    cut = [want[k : k + 3] for k in range(0, len(want), 3)]
    got = "".join(decoder.feed(np.array(c, np.int64)) for c in cut) + decoder.feed(np.zeros(0, np.int64), True)
    assert got == library.decode(want, skip_special_tokens=False) == text


def test_state_stays_small_in_an_endless_word(vocab_path):
    vocab = bpe.vocabulary(vocab_path)
    segmenter = bpe.Segmenter(vocab)
    text = "abcdefghij" * 20_000
    for at in range(0, len(text), 1000):
        segmenter.feed(text[at : at + 1000])
        assert len(segmenter.run or b"") + len(segmenter.tail) < 10_000


def test_decoder_replaces_what_is_not_utf8(vocab_path):
    vocab, library = bpe.vocabulary(vocab_path), _library(vocab_path)
    ids = [k for k, t in enumerate(vocab.tokens) if t[:1] >= b"\x80"][:200] + [100, 200, 150]
    assert bpe.Decoder(vocab).feed(np.array(ids), True) == library.decode(ids, skip_special_tokens=False)


def test_digest(docs, empty, rows, vocab_path):
    library = _library(vocab_path)
    got = sorted(map(tuple, bpe.bpe_digest(docs, vocab_path).drop("decoded_equal").collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.bpe_digest(empty, vocab_path).count() == 0


def test_columns_round_trip(docs, rows, vocab_path):
    ids = bpe.encode_column(docs, vocab_path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(ids, vocab_path).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i is not None)


def test_special_tokens_in_any_order(vocab_path):
    vocab = bpe.Vocabulary(vocab_path)
    vocab.special = {"<b>": 7, "<a>": 8, "<a><b>": 9}
    pieces = bpe.Segmenter(vocab).feed("x <a> y <b> z <a><b><b>", True)
    assert [int(p[0]) for p in pieces if not isinstance(p, str)] == [8, 7, 9, 7]
