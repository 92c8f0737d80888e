"""Packing token sequences by column generation for the cutting-stock problem.

Documents become pieces: every full `capacity` tokens, then the rest. The histogram of piece lengths (never more than
`capacity` numbers) goes to the driver, where a linear program over packing patterns is solved. It begins with one plain
pattern a length; knapsack dynamic programming prices all other patterns, until a bound shows that the program is within
`GAP` of its optimum or no pattern lowers its cost. Patterns are rounded down, what is left is filled by decreasing length, and each pattern's
places are dealt to the pieces ranked within their length: a join with a table that grows with the number of lengths
only. Ranks come from small salted groups, so a length that many pieces share is ranked by many tasks.

A sequence whose tokens number a power of two needs no padding; its pattern costs that much less.

Defined results: a null or empty text has the one token that ends a document; repeated rows are packed once each;
equal lengths are ranked by id and start; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, encoder, vocabulary
from .common import chunks, documents, written

CAPACITY = 1024
END = 0
#: Pricing ends within this share of the linear program's optimum, or within one sequence of it.
GAP = 1e-3
#: Rounds of pricing at most; a warning tells if they end before that is proven.
ROUNDS = 300
#: While plain columns are driven out, how far multipliers are drawn to the best known ones, and how much more a long
#: length is worth than its tokens, so that short ones are left to fill up with.
DRAWN, LONGER = 0.9, 0.1
#: What counts as nothing in costs and uses.
TINY = 1e-9
#: Rows that are ranked together, and the most groups of such rows (their counts are broadcast).
GROUP_ROWS, GROUPS = 400, 100_000


def padded(fill: int, capacity: int = CAPACITY) -> int:
    """Tokens that a sequence with `fill` tokens takes."""
    return fill if fill & (fill - 1) == 0 else capacity


class Program:
    """min cost·x, A x >= demand, x >= 0 over patterns; a revised simplex method with an explicit inverse.

    The first basis is plain: every length fills sequences by itself. All other columns come from the knapsack program.
    Arithmetic is elementwise: no linear-algebra library runs in the driver, whose threads may not survive a fork.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.lengths, self.demand, self.capacity = lengths, demand, capacity
        copies = capacity // lengths
        self.patterns: list[dict[int, int]] = [{k: int(a)} for k, a in enumerate(copies)]
        self.plain = np.ones(len(lengths), bool)
        self.cost = np.array([self.cost_of(p) for p in self.patterns])
        self.inverse = np.diag(1.0 / copies)
        self.x = demand / copies
        self.y = self.cost / copies
        self.bound = self.ideal = float((lengths * demand).sum()) / capacity
        #: The best multipliers known, which no pattern exceeds in worth; at first each token's share of a sequence.
        self.center = lengths / capacity
        self.rounds = self.entered = 0
        self.ended = ""

    def cost_of(self, pattern: dict[int, int]) -> float:
        """Padded size in sequences; a surplus (one copy less) costs nothing."""
        fill = sum(int(self.lengths[k]) * a for k, a in pattern.items())
        return padded(fill, self.capacity) / self.capacity if fill > 0 else 0.0

    def total(self) -> float:
        return float((self.cost * self.x).sum())

    def near(self, gap: float) -> bool:
        """Whether the best bound known shows that the program is near its optimum."""
        return self.total() <= max(self.bound * (1 + gap), self.bound + 1)

    def price(self, worth: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Knapsack dynamic program over lengths `among`: best worth of exactly 0, 1, ... tokens, and the last place in among."""
        lengths, worth = self.lengths[among], worth[among]
        value = np.full(self.capacity + 1, -np.inf)
        value[0] = 0.0
        last = np.zeros(self.capacity + 1, np.int64)
        fits = np.searchsorted(lengths, np.arange(self.capacity + 1), "right")
        for c in range(int(lengths[0]), self.capacity + 1):
            k = fits[c]
            got = value[c - lengths[:k]] + worth[:k]
            last[c] = at = int(got.argmax())
            value[c] = got[at]
        return value, last

    def pattern(self, last: np.ndarray, among: np.ndarray, fill: int, first: int | None = None) -> dict[int, int]:
        out: dict[int, int] = {} if first is None else {first: 1}
        while fill > 0:
            k = int(among[last[fill]])
            out[k] = out.get(k, 0) + 1
            fill -= int(self.lengths[k])
        return out

    def enter(self, pattern: dict[int, int]) -> bool:
        """Takes a pattern into the basis if that lowers the cost."""
        at = np.fromiter(pattern, np.int64)
        many = np.fromiter(pattern.values(), np.float64)
        cost = self.cost_of(pattern)
        gain = float((self.y[at] * many).sum()) - cost
        if gain < TINY:
            return False
        u = (self.inverse[:, at] * many).sum(1)
        rows = np.flatnonzero(u > 1e-10)
        if not len(rows):
            return False
        out = int(rows[(self.x[rows] / u[rows]).argmin()])
        step = max(0.0, self.x[out] / u[out])
        row = self.inverse[out] / u[out]
        touched = np.flatnonzero(np.abs(u) > 1e-12)
        live = np.flatnonzero(row)
        self.inverse[np.ix_(touched, live)] -= np.multiply.outer(u[touched], row[live])
        self.inverse[out] = row
        self.x = np.maximum(self.x - step * u, 0.0)
        self.x[out] = step
        self.patterns[out], self.cost[out], self.plain[out] = pattern, cost, False
        self.y = self.y - gain * row
        self.entered += 1
        return True

    def _round(self, among: np.ndarray, per_round: int, smooth: float) -> int:
        """Prices columns over lengths `among` and enters those that lower the cost; lengths in common keep for later."""
        self.rounds += 1
        whole = len(among) == len(self.lengths)
        center = self.center if whole else self.center * (1 + LONGER * self.center)
        worth = smooth * center + (1 - smooth) * np.maximum(self.y, 0.0)
        value, last = self.price(worth, among)
        best = np.maximum.accumulate(value)
        fill = np.maximum.accumulate(np.where(value >= best, np.arange(len(value)), 0))
        if whole:
            powers = [1 << k for k in range(self.capacity.bit_length()) if 1 << k < self.capacity]
            rate = max(1.0, float((worth + best[self.capacity - self.lengths]).max()), *(value[c] * self.capacity / c for c in powers))
            if (low := float((worth * self.demand).sum()) / rate) > self.bound:
                self.bound, self.center = low, worth / rate
            entered = sum(self.enter(self.pattern(last, among, c)) for c in powers if np.isfinite(value[c]))
            order = among[np.argsort(-(worth + best[self.capacity - self.lengths]))]
        else:
            entered, order = 0, among[::-1]
        used: set[int] = set()
        for k in order.tolist():
            if entered >= per_round:
                break
            if k in used:
                continue
            pattern = self.pattern(last, among, int(fill[self.capacity - self.lengths[k]]), k)
            if not used & pattern.keys():
                used |= pattern.keys()
                entered += self.enter(pattern)
        return entered

    def solve(self, gap: float = GAP, rounds: int = ROUNDS, per_round: int = 16) -> float:
        """Generates columns until the cost is near the bound or no column lowers it; gives the bound.

        While lengths still fill sequences by themselves, columns are priced among these, long ones first, so that
        each one drives a plain column out; then among all. Multipliers are drawn towards the best ones known, less
        so whenever no column is found. `ended` tells what ended the search: gap, optimum or rounds.
        """
        smooth, plain, everything = DRAWN, True, np.arange(len(self.lengths))
        while not self.near(gap):
            if self.rounds >= rounds:
                self.ended = "rounds"
                return self.bound
            if plain:
                open_ = np.flatnonzero(self.plain & (self.x > TINY))
                plain = len(open_) > 0 and self._round(open_, per_round, DRAWN) > 0
                continue
            for k in np.flatnonzero(self.y < -TINY).tolist():
                self.enter({k: -1})
            if not self._round(everything, per_round, smooth):
                if not smooth:
                    self.ended = "optimum"
                    return self.bound
                smooth = smooth / 2 if smooth > 0.05 else 0.0
        self.ended = "gap"
        return self.bound


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: copies) and how often each is used, so that every piece has its place exactly once."""
    rest = {n: c for n, c in histogram.items() if c > 0}
    plan = [({capacity: 1}, rest.pop(capacity))] if capacity in rest else []
    if not rest:
        return plan
    lengths = np.array(sorted(rest), np.int64)
    program = Program(lengths, np.array([rest[int(n)] for n in lengths], np.float64), capacity)
    program.solve(gap)
    if program.ended == "rounds":
        warnings.warn(f"packing: {program.rounds} rounds of pricing end {program.total() / program.bound - 1:.2%} above the bound", stacklevel=2)
    left = np.array([rest[int(n)] for n in lengths], np.int64)
    for extra in (False, True):  # whole parts first, then fractions, large ones first, as long as pieces are left
        for k in np.argsort(-(program.x - np.floor(program.x + 1e-9))):
            if min(program.patterns[k].values()) < 0:
                continue
            at = np.fromiter(program.patterns[k], np.int64)
            many = np.fromiter(program.patterns[k].values(), np.int64)
            times = int((left[at] // many).min())
            times = min(times, 1 if extra else math.floor(program.x[k] + 1e-9))
            if times > 0:
                left[at] -= many * times
                plan.append(({int(lengths[i]): int(a) for i, a in zip(at, many, strict=True)}, times))
    while left.any():
        room, pattern = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            if a := min(int(left[i]), room // int(lengths[i])):
                pattern[int(lengths[i])] = a
                room -= a * int(lengths[i])
        times = min(int(left[np.searchsorted(lengths, n)]) // a for n, a in pattern.items())
        for n, a in pattern.items():
            left[np.searchsorted(lengths, n)] -= a * times
        plan.append((pattern, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, copies, sequence, offset): whom of a length, by rank, each pattern takes, and where to."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for n, a in sorted(pattern.items(), reverse=True):
            low = taken.get(n, 0)
            taken[n] = low + a * times
            out.append((n, low, low + a * times, a, sequence, at))
            at += n * a
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces with sequence_id and offset; it has a column length (1 to capacity) and is read three times."""
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = plan_patterns(histogram, capacity)
    schema = "length long, low long, high long, copies long, first_sequence long, first_offset long"
    table = spark.createDataFrame(places(plan), schema)
    rows = max(GROUP_ROWS, -(-sum(histogram.values()) // GROUPS))
    salts = spark.createDataFrame([(n, -(-c // rows)) for n, c in histogram.items()], "length long, n_salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*order), F.col("n_salts"))).drop("n_salts")
    groups = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)))
    ranked = ranked.join(F.broadcast(groups), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    placed = ranked.join(F.broadcast(table), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    out = placed.withColumns({
        "sequence_id": F.col("first_sequence") + F.floor(nth / F.col("copies")).cast("long"),
        "offset": F.col("first_offset") + F.pmod(nth, F.col("copies")) * F.col("length"),
    })
    return out.select(*pieces.columns, "sequence_id", "offset")


@functools.lru_cache(maxsize=4)
def fast_encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary file's BPE in compiled form, one for each worker."""
    vocab = vocabulary(path)
    special = set(vocab.special.values())
    ranks = {t: k for k, t in enumerate(vocab.tokens) if k not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocab.special)


#: A run of white space this long is too much for the compiled pre-tokenizer; such texts go through the transducer.
LONG_SPACE = 50_000
_SPACE = re.compile(r"\s+")


def has_long_space(text: str, least: int = LONG_SPACE) -> bool:
    """Whether white space runs that long somewhere; every run is looked at once."""
    return len(text) >= least and any(m.end() - m.start() >= least for m in _SPACE.finditer(text))


def text_ids(text: str, path: str) -> list[int]:
    """The ids of a text, special tokens as themselves."""
    coder = fast_encoding(path)
    if has_long_space(text):
        return encoder(path).encode(text).tolist()
    if any(s in text for s in coder.special_tokens_set):
        return coder.encode(text, allowed_special="all")
    return coder.encode_ordinary(text)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            ids = text_ids(text, path)
            ids.append(END)
            data = np.array(ids, "<u4").tobytes()
            rows.extend((doc_id, at, min(capacity, len(ids) - at), zlib.crc32(data[4 * at : 4 * (at + capacity)]), len(ids)) for at in range(0, len(ids), capacity))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each text's pieces; `path` is the vocabulary file."""
    return documents(docs).mapInArrow(lambda b: _pieces(b, path, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_texts(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Contract columns: every piece of every text with its place."""
    return pack(written(pieces_of(docs, path, capacity), "pieces"), capacity)
