"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding. A text is fed in blocks. Words of the pre-tokenizer are final once two more characters follow them; inside a
word without end, the merge list itself says how far ahead one must look: a merge (x, y) can only be prevented by merges
of lower rank that eat y from the right, so a chain of merges with falling ranks bounds the bytes that matter
(`sufficient_lookahead`). Tokens that end before that margin are final and leave; the rest waits. So the state is a tail
of bounded length, whatever the text.

Decoding. Ids become bytes, and an incremental UTF-8 machine that holds three bytes at most turns them to text, U+FFFD
for what is not UTF-8.

Defined results: a null or empty text has no tokens; the string of a special token in a text is that token; nothing
depends on other columns, ties or repeated rows.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, documents

#: The pre-tokenizer's pattern, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that can still move a boundary behind them: those of 'll after the apostrophe.
WORD_MARGIN = 2
#: Characters fed at once, and words kept in each of a worker's two generations of encoded words.
BLOCK = 1 << 16
CACHE = 250_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE file: token bytes by id, merges by the pair of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, k in ids.items():
            if token not in self.special:
                self.tokens[k] = to_bytes(token)
        for token, k in self.special.items():
            self.tokens[k] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left << 20 | self.right
        self.by_key = np.argsort(keys)
        self.keys = np.append(keys[self.by_key], _NONE)
        self.ranks = np.append(self.by_key, len(keys))
        self.byte_ids = np.zeros(256, np.int64)
        for token, k in ids.items():
            if len(token) == 1 and token in letters:
                self.byte_ids[letters[token]] = k
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lookahead = self.sufficient_lookahead()

    def first_special(self, text: str) -> tuple[int, str, int] | None:
        """Place, string and id of the first special token in a text; of those at one place the longest."""
        found = [(at, -len(t), t, k) for t, k in self.special.items() if (at := text.find(t)) >= 0]
        if not found:
            return None
        at, _, token, k = min(found)
        return at, token, k

    def sufficient_lookahead(self) -> int:
        """Bytes behind a token that decide whether it stands, from the merge list."""
        reach: dict[int, int] = {}  # by token: the longest chain that merges so far, it being the left part, can start
        edge: dict[int, int] = {}  # by token: the same for what may eat its right end before it is made
        most = 0
        for a, b, made in zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True):
            edge[made] = max(reach.get(b, 0), edge.get(b, 0))
            chain = int(self.lengths[b]) + max(reach.get(b, 0), edge.get(b, 0))
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.made))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word: in every round each word merges all places of its lowest pair, left ones first."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list[np.ndarray] = [symbols[:0]] * len(words)
        top = len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), top, np.int64)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank(symbols[:-1], symbols[1:]), top)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(symbols)])
            least = np.minimum.reduceat(rank, first)
            done = least == top
            if done.any():
                ends = np.repeat(done, size)
                for piece, w in zip(np.split(symbols[ends], np.cumsum(size[done])[:-1]), owner[first[done]].tolist(), strict=True):
                    out[w] = piece
                symbols, owner, rank = symbols[~ends], owner[~ends], rank[~ends]
                least, size = least[~done], size[~done]
                if not len(symbols):
                    break
            here = rank == np.repeat(least, size)
            # In a row of overlapping places every second one counts, from the left.
            at = np.flatnonzero(here)
            run = np.cumsum(np.r_[0, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[nth % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def text_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        sizes = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)].tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and worker."""
    return Vocabulary(path)


_WORD = regex.compile(PATTERN)
_KINDS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]


class Segmenter:
    """Cuts a text, fed in blocks, into final pieces: words (str), tokens of endless words and special ones (array)."""

    def __init__(self, vocab: Vocabulary, most: int = 4096):
        self.vocab = vocab
        self.most = max(most, WORD_MARGIN + 2)
        self.tail = ""  # not final yet
        self.run: bytes | None = None  # the rest of a word whose beginning has left
        self.kind = _KINDS[0]

    def feed(self, text: str, last: bool = False) -> list:
        text, out = self.tail + text, []
        self.tail = ""
        while found := self.vocab.first_special(text):
            at, token, k = found
            self._words(text[:at], True, out)
            out.append(np.array([k]))
            text = text[at + len(token) :]
        held = 0
        if not last:
            held = max((n for t in self.vocab.special for n in range(1, len(t)) if text.endswith(t[:n])), default=0)
        self._words(text[: len(text) - held], last, out)
        self.tail += text[len(text) - held :]
        return out

    def _words(self, text: str, last: bool, out: list) -> None:
        if self.run is not None:
            text = self._go_on(text, last, out)
            if self.run is not None:
                self.tail = text
                return
        if last:
            out.extend(_WORD.findall(text))
            return
        found = [m.span() for m in _WORD.finditer(text)]
        keep = len(found) - 1
        while keep > 0 and found[keep - 1][1] > len(text) - WORD_MARGIN:
            keep -= 1
        out.extend(text[a:b] for a, b in found[: max(keep, 0)])
        rest = text[found[keep][0] :] if found else ""
        if found and keep == len(found) - 1 and len(rest) > self.most:
            body = rest[1:] if rest[0] == " " and not rest.isspace() else rest
            self.kind = next(k for k in _KINDS if k.match(body))
            self.run = b""
            self.tail = self._go_on(rest, False, out, len(rest))
        else:
            self.tail = rest

    def _go_on(self, text: str, last: bool, out: list, to: int | None = None) -> str:
        """Lengthens the word under way by text; gives what does not belong to it, or may not."""
        if to is None:
            m = self.kind.match(text)
            to = m.end() if m else 0
        goes_on = to == len(text) and not last
        if self.kind is _KINDS[2] and (goes_on or to < len(text)):
            to = max(0, to - 1)  # the last white space before another word belongs to that
        self.run += text[:to].encode()
        tokens = self.vocab.merge([self.run])[0] if self.run else np.zeros(0, np.int64)
        if goes_on:
            ends = np.cumsum(self.vocab.lengths[tokens])
            n = int(np.searchsorted(ends, len(self.run) - self.vocab.lookahead, "right"))
            if n:
                out.append(tokens[:n])
                self.run = self.run[ends[n - 1] :]
        else:
            out.append(tokens)
            self.run = None
        return text[to:]


class Encoder:
    """Ids of pieces; words met before are looked up in two generations, of which the older one goes when full."""

    def __init__(self, vocab: Vocabulary, size: int = CACHE):
        self.vocab, self.size = vocab, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Makes every one of words known."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        fresh = set(words).difference(self.young)
        for w in fresh.intersection(self.old):
            self.young[w] = self.old[w]
        fresh = [w for w in fresh if w not in self.young]
        for at in range(0, len(fresh), 1 << 15):
            part = fresh[at : at + (1 << 15)]
            self.young.update(zip(part, (x.astype("<u4").tobytes() for x in self.vocab.merge([w.encode() for w in part])), strict=True))

    def ids(self, pieces: list) -> bytes:
        """Little-endian unsigned 32-bit ids of pieces, whose words are known."""
        get = self.young.__getitem__
        try:
            return b"".join(map(get, pieces))
        except TypeError:  # arrays are no words
            return b"".join(get(p) if isinstance(p, str) else p.astype("<u4").tobytes() for p in pieces)

    def encode(self, text: str, block: int = BLOCK) -> np.ndarray:
        """All ids of one text, block by block."""
        segmenter, out = Segmenter(self.vocab), []
        for at in range(0, max(1, len(text)), block):
            pieces = segmenter.feed(text[at : at + block], at + block >= len(text))
            self.learn(p for p in pieces if isinstance(p, str))
            out.append(self.ids(pieces))
        return np.frombuffer(b"".join(out), "<u4")


class Decoder:
    """Text of ids that come in pieces: bytes through an incremental UTF-8 machine."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        return self.machine.decode(self.vocab.text_bytes(ids), last)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder, and so one store of words, for each file and worker."""
    return Encoder(vocabulary(path))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_equal", pa.bool_())])


class _Digest:
    """What is kept of a text while its blocks pass."""

    def __init__(self, vocab: Vocabulary):
        self.segmenter, self.decoder = Segmenter(vocab), Decoder(vocab)
        self.ids, self.text, self.given, self.n = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0

    def add(self, ids: bytes, block: str, last: bool) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.given.update(block.encode())
        self.text.update(self.decoder.feed(np.frombuffer(ids, "<u4"), last).encode())

    def row(self, doc_id: int | None) -> tuple:
        return doc_id, self.n, self.ids.hexdigest(), self.text.hexdigest(), self.text.digest() == self.given.digest()


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for part in chunks(batches, "text"):
        states, waiting = [_Digest(coder.vocab) for _ in range(part.num_rows)], []

        def flush(waiting=waiting, states=states) -> None:
            coder.learn(p for _, pieces, _, _ in waiting for p in pieces if isinstance(p, str))
            for k, pieces, block, last in waiting:
                states[k].add(coder.ids(pieces), block, last)
            waiting.clear()

        size = 0
        for k, text in enumerate(part.column("text").to_pylist()):
            for at in range(0, max(1, len(text)), BLOCK):
                block, last = text[at : at + BLOCK], at + BLOCK >= len(text)
                waiting.append((k, states[k].segmenter.feed(block, last), block, last))
                size += len(block)
                if size >= 1 << 20:
                    flush()
                    size = 0
        flush()
        rows = [s.row(i) for s, i in zip(states, part.column("doc_id").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Contract columns: each text encoded and decoded again; `path` is the vocabulary file, there on every worker."""
    return documents(docs).mapInArrow(lambda b: _digest(b, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean")


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in chunks(batches, "text"):
            ids = [coder.encode(t).astype(np.int32) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each list of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder, ids = Decoder(vocab), np.array(ids or [], np.int64)
                texts.append("".join(decoder.feed(ids[at : at + BLOCK], at + BLOCK >= len(ids)) for at in range(0, max(1, len(ids)), BLOCK)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"cast({id_col} as long) as doc_id", f"{ids_col} as ids").mapInArrow(run, "doc_id long, text string")
