"""Masked pseudo-likelihood of documents.

A token is hidden and predicted from the `SIDE` tokens on each side of it by a window network: a table for each place of
the window turns its token into hidden units, these go through tanh and a softmax over the vocabulary. A document's score
is the sum of its tokens' conditional log-probabilities, its mean the sum by its tokens.

The vocabulary is every word of the corpus, and grows with it. The network sees 1,503 frequent words as
themselves and all others by 544 buckets of their hash, and predicts a token's class: the most frequent words are classes
by themselves, all others share buckets. A word's probability is that of its class in its window times
its share of the class, which is read by a join from the counts of all words, shuffled from all documents; words that
were never counted share what the counts leave. The network is trained in numpy by every map task on all its documents,
from a common start; their networks are averaged by tokens, and further rounds begin from there.

Defined results: a null or empty text has no tokens, score 0 and a null mean; a window that sticks out of the text sees
the edge token; repeated rows score alike; other columns are kept out by name; a table without words gives scores of an
untrained network.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, raw_text, written

#: Tokens: EDGE, then frequent words, then buckets of other words by their hash. This many of them are seen in windows.
EDGE = 0
SEEN, SEEN_BUCKETS = 1503, 544
TOKENS = 1 + SEEN + SEEN_BUCKETS
#: Classes: EDGE, then the most frequent of these words, then buckets of all others by the same hash.
TOP, BUCKETS = 95, 32
SIZE = 1 + TOP + BUCKETS
SIDE = 2
HIDDEN = 16
BATCH, RATE, ROUNDS, SEED = 1024, 1.0, 3, 5
#: What each word of a class is counted more than it was met, and as many uncounted words as counted ones are met. Sums of
#: logarithms are taken of whole numbers, so that repeated rows have the same sum in any order.
EXTRA, SCALE = 0.5, float(1 << 30)
#: Networks that are added up by one task.
FAN = 32


#: A batch's gradient is a sum of so many products.
BLOCKS = 8
#: Where the pairs of hidden units of each token are in the table of a place.
_PAIRS = np.arange(TOKENS * HIDDEN // 2).reshape(TOKENS, -1)


class Network:
    """Tables (place, token, hidden), output weights (hidden, class) and bias (class)."""

    def __init__(self, tables: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.tables = tables
        self.top = np.concatenate([out, bias[None]])  # the bias is the weight of a hidden unit that is always 1
        self.out, self.bias = self.top[:-1], self.top[-1]

    @staticmethod
    def start(bias: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.3, (2 * SIDE, TOKENS, HIDDEN)).astype(np.float32)
        return Network(tables, rng.normal(0, 0.1, (HIDDEN, SIZE)).astype(np.float32), bias.astype(np.float32))

    def hidden(self, seen: np.ndarray) -> np.ndarray:
        """Hidden units for windows of tokens, one row each, and the unit that is 1."""
        x = self.tables[0].take(seen[:, 0], 0)
        for k in range(1, 2 * SIDE):
            x += self.tables[k].take(seen[:, k], 0)
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(x, out=h[:, :-1])
        return h

    def _shift(self, z: np.ndarray, most: float) -> np.ndarray | float:
        """What is taken from logits so that exp() stays finite: nothing while their bound, as units are within 1, is low."""
        return z.max(1)[:, None] if np.abs(self.top).sum(0).max() > most else 0.0

    def log_probs(self, seen: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Of the classes in the middle of windows, in double precision, so that a window's value hardly depends on its place in the batch."""
        z = self.hidden(seen).astype(np.float64) @ self.top.astype(np.float64)
        if np.ndim(shift := self._shift(z, 600.0)):
            z -= shift
        picked = z[np.arange(len(z)), goal]
        np.exp(z, out=z)
        return picked - np.log(z @ np.ones(SIZE))

    def learn(self, seen: np.ndarray, goal: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability of a batch."""
        n = len(goal)
        h = self.hidden(seen)
        z = h @ self.top
        if np.ndim(shift := self._shift(z, 60.0)):
            z -= shift
        np.exp(z, out=z)
        whole = z @ np.ones(SIZE, np.float32)
        z[np.arange(n), goal] -= whole
        share = (1 / (whole * n))[:, None]
        units = h[:, :-1]
        back = z @ self.out.T
        back *= 1 - units * units
        back *= share * np.float32(-rate * n**0.5)
        h *= share
        # As some short products, whose parts stay in the processor's cache.
        blocks = BLOCKS if n % BLOCKS == 0 else 1
        self.top -= rate * (h.reshape(blocks, -1, HIDDEN + 1).transpose(0, 2, 1) @ z.reshape(blocks, -1, SIZE)).sum(0)
        # A token's row moves by the sum over its places in the batch; two units are added at a time, as a complex number.
        pairs = back.view(np.complex64).ravel()
        for k in range(2 * SIDE):
            np.add.at(self.tables[k].view(np.complex64).ravel(), _PAIRS.take(seen[:, k], 0).ravel(), pairs)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.out.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        cut = [2 * SIDE * TOKENS * HIDDEN, 2 * SIDE * TOKENS * HIDDEN + HIDDEN * SIZE]
        t, o, b = np.split(flat.astype(np.float32), cut)
        return Network(t.reshape(2 * SIDE, TOKENS, HIDDEN), o.reshape(HIDDEN, SIZE), b)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Words of more bytes are hashed one by one.
LONG_WORD = 32


def crc32(words: pa.StringArray) -> np.ndarray:
    """zlib.crc32 of the UTF-8 of words, a byte of all at a time."""
    data, offsets = raw_text(words)
    starts, size = offsets[:-1], np.diff(offsets)
    out = np.full(len(size), 0xFFFFFFFF, np.uint32)
    at, left = 0, np.flatnonzero((size > 0) & (size <= LONG_WORD))
    while len(left):
        state = out[left]
        out[left] = _CRC[(state ^ data[starts[left] + at]) & 0xFF] ^ state >> np.uint32(8)
        at += 1
        left = left[size[left] > at]
    out = ~out
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + size[k]])
    return out


class Tokens:
    """Tokens of words: a frequent word has its own, others share a bucket."""

    def __init__(self, top: list[str]):
        self.top = pa.array(top, pa.string())

    def of(self, words: pa.StringArray) -> np.ndarray:
        rank = pc.fill_null(pc.index_in(words, self.top), -1).to_numpy().astype(np.int64)
        return np.where(rank >= 0, 1 + rank, 1 + SEEN + crc32(words).astype(np.int64) % SEEN_BUCKETS).astype("<i2")


def classes(top: list[str]) -> np.ndarray:
    """The class of every token, under the list of frequent words. SEEN_BUCKETS is a multiple of BUCKETS."""
    out = np.arange(TOKENS)
    out[1 + TOP : 1 + len(top)] = [1 + TOP + zlib.crc32(w.encode()) % BUCKETS for w in top[TOP:]]
    out[1 + SEEN :] = 1 + TOP + np.arange(SEEN_BUCKETS) % BUCKETS
    return out


def split(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts, in lower case, between white space, and the row of each."""
    lower = pa.array([t.lower() for t in texts.to_pylist()], pa.string())
    parts = pc.utf8_split_whitespace(lower)
    words, row = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.not_equal(words, "")  # before and behind white space at the ends of a text
    return words.filter(full), row.filter(full).to_numpy().astype(np.int64)


def windows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, and what each sees: SIDE tokens before it and SIDE behind it in its row."""
    edge = np.full(SIDE, EDGE, "<i2").tobytes()
    flat = np.frombuffer(edge + b"".join(r + edge for r in rows), "<i2")
    at = np.flatnonzero(flat)
    return flat[at], np.stack([flat[at + d] for d in range(-SIDE, SIDE + 1) if d], 1)


def _code(batches: Iterator[pa.RecordBatch], top: list[str]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(top)
    for part in chunks(batches, "text", 1 << 19):
        words, row = split(part.column("text"))
        entries = words.dictionary_encode()
        different, entry = entries.dictionary, entries.indices.to_numpy().astype(np.int64)
        token = tokens.of(different)[entry]
        ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
        codes = [token[a:b].tobytes() for a, b in pairwise(ends)]
        rest = token > SEEN
        met, times = np.unique(row[rest] * len(different) + entry[rest], return_counts=True)
        who, which = np.divmod(met, max(1, len(different)))
        at = pa.array(np.searchsorted(who, np.arange(part.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (different.take(pa.array(which)), pa.array(times, pa.int64()))]
        columns = [part.column("row"), part.column("doc_id"), pa.array(codes, pa.binary()), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "tokens", "words", "times"])


def coded(docs: DataFrame, top: list[str]) -> DataFrame:
    """row, doc_id, tokens, and the words not in top with how often each is met, of docs (doc_id, text)."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(partial(_code, top=top), "row long, doc_id long, tokens binary, words array<string>, times array<long>")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 1 << 22):
        counts = pc.value_counts(split(part.column("text"))[0])
        yield pa.RecordBatch.from_arrays(counts.flatten(), names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all of docs (doc_id, text); chunks of texts and tasks add up their own first."""
    return docs.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _train(batches: Iterator[pa.RecordBatch], weights: np.ndarray, top: list[str], rate: float) -> Iterator[pa.RecordBatch]:
    network, klass, seen = Network.of(weights), classes(top), 0
    for part in chunks(batches, "tokens", 1 << 18):
        token, window = windows(part.column("tokens").to_pylist())
        goal = klass[token]
        for at in range(0, len(goal), BATCH):
            network.learn(window[at : at + BATCH], goal[at : at + BATCH], rate)
        seen += len(token)
    if seen:
        task = TaskContext.get().partitionId()
        yield _network(task, seen, network.flat().astype(np.float64) * seen)


_NETWORK_SQL = "task long, n long, weights binary"


def _network(task: int, n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task]), pa.array([n]), pa.array([total.astype("<f8").tobytes()])], names=["task", "n", "weights"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the networks of FAN tasks each, which come in the order of tasks."""
    group, n, total = None, 0, None
    for batch in batches:
        for task, k, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is not None and task // FAN != group:
                yield _network(group, n, total)
                n, total = 0, None
            part = np.frombuffer(w, "<f8")
            group, n, total = task // FAN, n + k, part if total is None else total + part
    if n:
        yield _network(group, n, total)


def average(networks: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of networks (task, n, weights: n times theirs), by levels of FAN, always added in the same order."""
    while tasks > FAN:
        dealt = networks.repartition(-(-tasks // FAN), F.floor(F.col("task") / FAN)).sortWithinPartitions("task")
        networks, tasks = dealt.mapInArrow(_sum, _NETWORK_SQL), -(-tasks // FAN)
    found = sorted(networks.collect(), key=lambda r: r["task"])  # FAN at most
    n = sum(r["n"] for r in found)
    return sum(np.frombuffer(r["weights"], "<f8") for r in found) / n if n else None


@dataclass
class Model:
    """Frequent words, the first TOP of which are classes by themselves, and the weights of the network over classes.

    The network's size is fixed; what grows with the corpus are the counts of word_counts(), which stay a table.
    """

    top: list[str]
    weights: np.ndarray


def frequent(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The words that are seen as themselves, and the counts of all classes, one more for each."""
    words = counts.orderBy(F.desc("n"), "word").limit(SEEN).collect()
    best = words[:TOP]
    rest = counts.agg(F.sum("n")).first()[0] or 0
    share = np.full(SIZE, 1.0)
    share[1 : 1 + len(best)] += [r[1] for r in best]
    share[1 + TOP :] += max(0, rest - sum(r[1] for r in best)) / BUCKETS
    return [r[0] for r in words], share


def fit(codes: DataFrame, top: list[str], share: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model of the documents of coded(): rounds of training by all tasks on all documents."""
    weights = Network.start(np.log(share / share.sum())).flat()
    for _ in range(rounds):
        tokens = codes.select("tokens")
        mean = average(tokens.mapInArrow(partial(_train, weights=weights, top=top, rate=rate), _NETWORK_SQL), tokens.rdd.getNumPartitions())
        weights = weights if mean is None else mean.astype(np.float32)
    return Model(top, weights)


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model of docs (doc_id, text): word counts of all, then rounds of training by all tasks on all documents."""
    top, share = frequent(written(word_counts(docs), "counts"))
    return fit(written(coded(docs, top), "coded"), top, share, rounds, rate)


def _score(batches: Iterator[pa.RecordBatch], model: Model, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    network, klass = Network.of(model.weights), classes(model.top)
    known = np.rint(known * SCALE).astype(np.int64)
    for part in chunks(batches, "tokens", 1 << 18):
        rows = part.column("tokens").to_pylist()
        token, window = windows(rows)
        goal = klass[token]
        logs = np.empty(len(token), np.int64)  # whole numbers, whose sums are exact
        for at in range(0, len(token), BATCH):
            logs[at : at + BATCH] = np.rint(network.log_probs(window[at : at + BATCH], goal[at : at + BATCH]) * SCALE)
        logs += known[token]
        size = np.array([len(r) // 2 for r in rows], np.int64)
        total = np.diff(np.r_[0, np.cumsum(logs)][np.r_[0, np.cumsum(size)]]) / SCALE
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(size), pa.array(total)], names=["row", "doc_id", "n_tokens", "log_prob"])


def _class_scores(codes: DataFrame, model: Model, known: np.ndarray | None = None) -> DataFrame:
    """Of tokens' classes, and of what is known of tokens' shares of their classes."""
    known = np.zeros(TOKENS) if known is None else known
    return codes.select("row", "doc_id", "tokens").mapInArrow(partial(_score, model=model, known=known), "row long, doc_id long, n_tokens long, log_prob double")


def _with_mean(scored: DataFrame) -> DataFrame:
    mean = F.try_divide(F.col("log_prob"), F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of the classes of each row's tokens, of docs (doc_id, text)."""
    return _with_mean(_class_scores(coded(docs, model.top), model))


def _bucket() -> Column:
    return F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).cast("int")


def bucket_logs(counts: DataFrame, top: list[str]) -> list[float]:
    """The logarithms of what words' shares of each bucket are taken of.

    A word counted n times has (n + EXTRA) / (N + 2 EXTRA T) of a bucket with T words counted N times in all; as many
    words again as were counted are taken to be still unmet, and have EXTRA each.
    """
    rest = counts.where(~F.col("word").isin(top[:TOP])) if top else counts
    sums = {r["bucket"]: r["n"] + 2 * EXTRA * r["t"] for r in rest.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect()}
    return [log(sums.get(b, 2 * EXTRA)) for b in range(BUCKETS)]


def known_shares(counts: DataFrame, top: list[str], logs: list[float]) -> np.ndarray:
    """The log-share of its class of each token that stands for a word which shares a bucket (others: 0)."""
    times = {r["word"]: r["n"] for r in counts.where(F.col("word").isin(top[TOP:])).collect()} if top[TOP:] else {}  # SEEN at most
    out = np.zeros(TOKENS)
    for k, w in enumerate(top[TOP:], 1 + TOP):
        out[k] = log(times.get(w, 0) + EXTRA) - logs[zlib.crc32(w.encode()) % BUCKETS]
    return out


def shares(codes: DataFrame, counts: DataFrame, top: list[str], logs: list[float] | None = None) -> DataFrame:
    """row and share: the sum of its words' log-shares of their buckets, of rows of coded() with words not in top.

    Each counted word has its log-share before the join. The counts have each word once, so they are dealt evenly and
    looked up by hash: neither side is sorted.
    """
    whole = F.array(*(F.lit(x) for x in logs or bucket_logs(counts, top)))

    def log_share(n: Column) -> Column:
        return F.round((F.ln(n + EXTRA) - F.get(whole, _bucket())) * SCALE).cast("long")

    rest = counts.where(~F.col("word").isin(top)) if top else counts
    known = rest.select("word", log_share(F.col("n")).alias("known")).hint("shuffle_hash")
    met = codes.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    part = F.coalesce(F.col("known"), log_share(F.lit(0)))
    joined = met.join(known, "word", "left").select("row", (F.col("times") * part).alias("part"))
    return joined.groupBy("row").agg((F.sum("part") / SCALE).alias("share"))


def _word_scores(codes: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    logs = bucket_logs(counts, model.top)
    scored = _class_scores(codes, model, known_shares(counts, model.top, logs))
    scored = scored.join(shares(codes, counts, model.top, logs), "row", "left")
    return _with_mean(scored.withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("share"), F.lit(0.0))))


def score_words(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """As score(), of the words themselves, under a model and the counts (word, n) of the corpus that it was trained on."""
    return _word_scores(written(coded(docs, model.top), "coded"), counts, model)


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents, word by word, under a model trained on all of them."""
    docs = documents(df, id_col, text_col)
    counts = written(word_counts(docs), "counts")
    top, share = frequent(counts)
    codes = written(coded(docs, top), "coded")
    return _word_scores(codes, counts, fit(codes, top, share))
