"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document with a smaller id, cut into content-defined blocks of words that overlap by a window
less one word; all of them are indexed (`index_blocks`). Blocks that the reference holds as a whole are factors as they
are. In the other blocks whose anchor the reference knows, a greedy parse goes from left to right: the longest string of
words from here on that some reference block holds is a factor, 13 words long at least; behind it the parse goes on with
the first window that reaches over the factor's end, so none across a boundary is missed. Words that begin no such string
are literals. Factors are duplicate spans. Blocks overlap, and factors of neighbouring blocks with them.

A factor is found by walking a suffix automaton of the reference blocks, whose letters are their windows: it holds all
substrings in room that is linear in the blocks, and a walk takes a step a window, however often a string occurs. Blocks
that it holds already are not added, so a window that all documents have takes no more room than once.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined results: a null or empty text has no words; documents shorter than a
window lose nothing; rows with the same id are versions of one document (see suffix.py) and null ids take no part; of
equal texts the one with the least id stays; other columns are kept out by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Shape, covered, index_blocks, span_lists, with_spans
from .common import chunks, documents, forget, mix, raw_text, signed, words_of, written

WINDOW = 13
ANCHOR = 5
#: What stands between words where contents are compared.
SPACE = b" "


def shape(window: int = WINDOW) -> Shape:
    return Shape("words", window, min(ANCHOR, window))


def _bodies(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The contested blocks' words, one space between them: key, doc_id, lo, body.

    Blocks of frequent anchors come window by window, with keys of their own; those that a smaller document here has
    too have no body.
    """
    for part in chunks(batches, "text", 1 << 19):
        data, offsets = raw_text(part.column("text"))
        starts, ends, counts = words_of(data, offsets)
        inner = np.r_[0, np.cumsum(counts)]
        row, lo, many = span_lists(part.column("spans"))
        keys = part.column("spans").flatten().field(2)
        alone = keys.is_null().to_numpy(zero_copy_only=False)
        keys = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
        fits = inner[row] + lo + many + window - 1 <= inner[row + 1]
        row, lo, many, alone, keys = (x[fits] for x in (row, lo, many, alone, keys))
        size = np.where(alone, many, 1)
        lo = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, many, keys, alone = np.repeat(row, size), np.repeat(np.where(alone, 1, many), size), np.repeat(keys, size), np.repeat(alone, size)
        # All words once, each with a space behind it: a block is a slice of that.
        letters = ends - starts
        place = np.r_[0, np.cumsum(letters + 1)]
        flat = np.full(int(place[-1]), SPACE[0], np.uint8)
        to = np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters, letters)
        flat[to + np.repeat(place[:-1], letters)] = data[to + np.repeat(starts, letters)]
        first = inner[row] + lo
        begin, end = place[first], place[first + many + window - 1] - 1
        body = flat.tobytes()
        bodies = [body[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
        if alone.any():
            least: dict[bytes, int] = {}
            at = np.flatnonzero(alone)
            for k in at[np.argsort(doc[at], kind="stable")].tolist():
                known = least.setdefault(bodies[k], int(doc[k])) < doc[k]
                keys[k] = signed(mix(np.array([k], np.uint64)))[0] if known else int.from_bytes(hashlib.blake2b(bodies[k], digest_size=8).digest(), "little", signed=True)
                bodies[k] = b"" if known else bodies[k]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(bodies, pa.binary())], names=["key", "doc_id", "lo", "body"])


class Reference:
    """Blocks of smaller documents under one anchor, as a suffix automaton over their windows (a letter a different window).

    `blocks.HELD` bounds it: an anchor with more blocks than that has its windows sent each by itself.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.letters: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _windows(self, words: list[bytes]) -> list[bytes]:
        return [SPACE.join(words[k : k + self.window]) for k in range(len(words) - self.window + 1)]

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _walk(self, letters: list[int], at: int) -> int:
        """How many letters from `at` on the automaton holds as one string."""
        state: int | None = 0
        for k in range(at, len(letters)):
            state = self.moves[state].get(letters[k])
            if state is None:
                return k - at
        return len(letters) - at

    def _split(self, at: int, to: int, letter: int) -> int:
        """A state for the shorter strings of `to`, those that reach it from `at` and its suffixes."""
        short = self._state(dict(self.moves[to]), self.length[at] + 1, self.link[to])
        self.link[to] = short
        while at >= 0 and self.moves[at].get(letter) == to:
            self.moves[at][letter] = short
            at = self.link[at]
        return short

    def _next(self, at: int, letter: int) -> int:
        """The state of a block's letters so far and one more."""
        to = self.moves[at].get(letter)
        if to is not None:
            return to if self.length[to] == self.length[at] + 1 else self._split(at, to, letter)
        new = self._state({}, self.length[at] + 1, 0)
        while at >= 0 and letter not in self.moves[at]:
            self.moves[at][letter] = new
            at = self.link[at]
        if at >= 0:
            to = self.moves[at][letter]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, letter)
        return new

    def add(self, words: list[bytes]) -> None:
        letters = [self.letters.setdefault(x, len(self.letters)) for x in self._windows(words)]
        if self._walk(letters, 0) < len(letters):
            state = 0
            for c in letters:
                state = self._next(state, c)

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Place and length of the factors of words, by a greedy parse from left to right."""
        letters, at = [self.letters.get(x, -1) for x in self._windows(words)], 0
        while at < len(letters):
            many = self._walk(letters, at)
            if many:
                yield at, many + self.window - 1
            at += max(many, 1)  # the first window that reaches over the factor's end


def _parse(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Factors as spans of windows, of blocks in the order of key and document."""
    key, doc, waiting = None, None, []
    reference = Reference(window)
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for k, d, lo, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not body:
                out.append((d, lo, 1))
                continue
            if k != key:
                key, doc, waiting, reference = k, d, [], Reference(window)
            elif d != doc:
                for words in waiting:
                    reference.add(words)
                doc, waiting = d, []
            words = body.split(SPACE)
            out.extend((d, lo + at, length - window + 1) for at, length in reference.factors(words))
            waiting.append(words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "lo", "many"])


def factor_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Duplicate spans (doc_id, lo, many): windows that start in a smaller document too."""
    copied, contested, parts = index_blocks(docs.where("doc_id IS NOT NULL"), shape(window))
    lists = contested.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "many", "key")).alias("spans")).withColumnRenamed("doc_id", "span_doc")
    at_ends = docs.join(lists, docs["doc_id"] == lists["span_doc"]).select("doc_id", "text", "spans")
    blocks = at_ends.mapInArrow(partial(_bodies, window=window), "key long, doc_id long, lo int, body binary")
    in_order = blocks.repartition(parts, "key").sortWithinPartitions("key", "doc_id")
    spans = written(copied.unionByName(in_order.mapInArrow(partial(_parse, window=window), "doc_id long, lo int, many int")), "spans")
    forget(contested)
    return spans


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        data, offsets = raw_text(part.column("text"))
        starts, ends, counts = words_of(data, offsets)
        inner = np.r_[0, np.cumsum(counts)]
        row, lo, many = span_lists(part.column("spans"))
        gone = covered(inner, row, lo, many + window - 1)
        removed = np.diff(np.r_[0, np.cumsum(gone)][inner])
        # Kept words with one space behind each, copied in one go; a row's last space is left out of its hash.
        at, size = starts[~gone], (ends - starts)[~gone] + 1
        place = np.cumsum(size) - size
        body = np.full(int(size.sum()), 0x20, np.uint8)
        letters = size - 1
        to = np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters, letters)
        body[to + np.repeat(place, letters)] = data[to + np.repeat(at, letters)]
        cuts = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts - removed)]]
        body = body.tobytes()
        digests = [hashlib.sha256(body[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(removed), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def relative_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contract columns for every document."""
    docs = documents(docs)
    spans = factor_spans(docs, window)
    return with_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(partial(_kept, window=window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, {WINDOW}) r(k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
