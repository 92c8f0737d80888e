"""Language of texts: averaged embeddings of hashed subwords, a linear softmax over them, and calibrated rejection.

Subwords are runs of 2 to 4 letters of a word, its edges marked; other characters only part words. The network (an
embedding for each of BUCKETS hashes, weights from the mean embedding to languages) is trained in numpy by stochastic
gradient descent on a bounded sample: of each of the LANGS most frequent languages at most PER_LANG documents, of each at
most SAMPLE_CHARS characters from a place that its hash names. Every fifth of these is kept from training: on it a
temperature makes scores probabilities, and the score is found above which predictions reach the asked-for accuracy. All
texts are scored whole, block by block; mean and softmax weights are linear, so the two tables are multiplied first and
a subword costs one lookup. The sample goes by hashes of rows, so that a model does not hang on how a table is split.

A null or empty text, and one without letters, is `und` with score 0, as is every text where no labelled document is
there to learn from. With labels of one language alone all letters are taken for it. Null ids are held out of nothing and
not learned from. Equal texts score alike; equal rows are all kept and learned once. Other columns are not read.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents

SIZES = (2, 3, 4)
BUCKETS, WIDTH = 1 << 15, 16
LANGS, PER_LANG, SAMPLE_CHARS = 512, 1000, 4000
STEPS, BATCH, RATE = 1200, 32, 0.5
#: Characters that are hashed at once.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Accuracy that accepted predictions are to reach on the calibration part.
ACCURACY = 0.99


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of a text in small letters between two blanks, a blank for all that is no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    return np.where(_letters()[codes], codes, np.uint32(32))


def _hashed(codes: np.ndarray, starts: int | np.ndarray) -> Iterator[np.ndarray]:
    """For each size the buckets of subwords by their first place (BUCKETS: none begins there); starts: places to look at."""
    letter = codes != 32
    h = codes * np.uint32(0x9E3779B1)
    mixed = h ^ (h >> np.uint32(15))
    h = mixed
    inner = np.ones(len(codes), bool)
    for size in range(2, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            return
        h = (h[:n] * np.uint32(0x01000193)) ^ mixed[size - 1 :]
        if size > 2:
            inner = inner[:n] & letter[size - 2 : size - 2 + n]
        if size in SIZES:
            good = inner[:n] & (letter[:n] | letter[size - 1 :]) if size == 2 else inner[:n]
            bucket = ((h ^ np.uint32(size)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            yield np.where(good & (starts[:n] if isinstance(starts, np.ndarray) else np.arange(n) < starts), bucket, np.uint32(BUCKETS))


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords and how often each occurs."""
    found = [ids[ids < BUCKETS] for ids in _hashed(_codes(text), 1 << 62)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclass
class Model:
    """Languages, embeddings, softmax weights, temperature and the score that is accepted."""

    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    accepted: float = 0.0

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, langs=np.array(self.langs, object).astype(str), embeddings=self.embeddings, weights=self.weights, rest=[self.temperature, self.accepted])
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return Model(z["langs"].tolist(), z["embeddings"], z["weights"], *z["rest"].tolist())

    @functools.cached_property
    def table(self) -> np.ndarray:
        """What a subword adds to each language, and a count; the last row is no subword."""
        scores = self.embeddings.astype(np.float64) @ self.weights.astype(np.float64)
        return np.vstack([np.c_[scores, np.ones(len(scores))], np.zeros(scores.shape[1] + 1)])

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from sums of table rows."""
        z = sums[:, :-1] / np.maximum(sums[:, -1:], 1) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def descend(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], seed: int = 0) -> Model:
    """Embeddings and weights after STEPS batches, the examples in random order again and again, the rate falling to nothing."""
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, len(langs))).astype(np.float32)
    order: list[int] = []
    for step in range(STEPS):
        if len(order) < BATCH:
            order += rng.permutation(len(examples)).tolist()
        pick, order = order[:BATCH], order[BATCH:]
        here, at = np.unique(np.concatenate([examples[k][0] for k in pick]), return_inverse=True)
        x = np.zeros((len(pick), len(here)), np.float32)
        x[np.repeat(np.arange(len(pick)), [len(examples[k][0]) for k in pick]), at] = np.concatenate([examples[k][1] / examples[k][1].sum() for k in pick])
        hidden = x @ embeddings[here]
        z = hidden @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), labels[pick]] -= 1
        rate = np.float32(RATE * (1 - step / STEPS))
        back = x.T @ (p @ weights.T)
        weights -= rate * (hidden.T @ p)
        embeddings[here] -= rate * back
    return Model(langs, embeddings, weights)


def calibrate(model: Model, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, accuracy: float = ACCURACY) -> None:
    """The temperature of the highest likelihood, and the least score whose predictions upwards are as accurate as asked."""
    if not len(labels):
        return
    sums = np.array([(model.table[ids] * counts[:, None]).sum(0) for ids, counts in examples])

    def loss(log_t: float) -> float:
        model.temperature = float(np.exp(log_t))
        return -float(np.log(np.maximum(model.scores(sums)[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(40):  # the loss has one valley
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))
    p = model.scores(sums)
    best, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-best, kind="stable")
    falling = best[order]
    good = (np.cumsum(right[order]) >= accuracy * np.arange(1, len(order) + 1)) & np.r_[falling[1:] < falling[:-1], True]
    model.accepted = float(falling[np.flatnonzero(good)[-1]]) if good.any() else np.inf


def train(rows: list[tuple[str, str, int, bool]], per_lang: int = PER_LANG) -> Model | None:
    """A model of rows (lang, text, hash, whether it is for calibration), whole and as a few words each; None without letters."""
    taken: dict[str, list[tuple[int, str, bool]]] = {}
    for lang, text, h, late in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if len(taken.setdefault(lang, [])) < per_lang:
            taken[lang].append((h, text, late))
    langs = sorted(taken)
    parts: dict[bool, list[tuple[tuple[np.ndarray, np.ndarray], int]]] = {False: [], True: []}
    for k, lang in enumerate(langs):
        for h, text, late in taken[lang]:
            words = text.split()
            few = (h >> 8) % 8 + 1
            at = (h >> 16) % max(1, len(words) - few + 1)
            for piece in (text, " ".join(words[at : at + few])):
                example = subwords(piece)
                if len(example[0]):
                    parts[late].append((example, k))
    if not parts[False]:
        parts[False], parts[True] = parts[True], []
    if not parts[False]:
        return None
    model = descend([x for x, _ in parts[False]], np.array([k for _, k in parts[False]]), langs)
    calibrate(model, [x for x, _ in parts[True]], np.array([k for _, k in parts[True]], int))
    return model


def sample(docs: DataFrame, langs: int = LANGS, per_lang: int = PER_LANG) -> DataFrame:
    """lang, text, h and late of labelled documents that may be learned from: about per_lang of each frequent language.

    Only ids and labels are counted; whether a row is taken hangs on its hash and its language's number of rows.
    """
    rest = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5
    known = docs.where((rest != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(langs).collect()  # at most `langs` rows
    if not sizes:
        return known.sparkSession.createDataFrame([], "lang string, text string, h long, late boolean")
    share = F.element_at(F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(1.1 * per_lang / r["count"])))), F.col("lang").cast("string"))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("langid")), F.lit(1 << 40))
    rows = known.withColumns({"h": h, "late": rest == 1}).where(h < share * (1 << 40))
    start = 1 + F.col("h") % F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
    piece = F.substr("text", start.cast("int"), F.lit(SAMPLE_CHARS))
    return rows.select(F.col("lang").cast("string").alias("lang"), piece.alias("text"), "h", "late").distinct()


def fit(docs: DataFrame, langs: int = LANGS, per_lang: int = PER_LANG) -> Model | None:
    """The model of a table's labelled documents (doc_id, text, lang); one task trains it on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "h", "late")), strict=True)]
        model = train(rows, per_lang) if rows else None
        yield pa.RecordBatch.from_arrays([pa.array([model and model.dump()], pa.binary())], names=["model"])

    found = sample(docs, langs, per_lang).repartition(1).mapInArrow(run, "model binary").where("model IS NOT NULL").collect()
    return Model.load(bytes(found[0][0])) if found else None


def _sums(model: Model, texts: list[str]) -> np.ndarray:
    """Each text's sum of the table's rows; texts are hashed some at a time, long ones in blocks."""
    columns = np.ascontiguousarray(model.table.T)
    out = np.zeros((len(texts), len(columns)))
    waiting: list[tuple[int, np.ndarray, int]] = []

    def flush() -> None:
        if waiting:
            codes = np.concatenate([c for _, c, _ in waiting])
            offsets = np.cumsum([0, *(len(c) for _, c, _ in waiting)])
            starts = np.zeros(len(codes), bool)
            for (_, _, n), at in zip(waiting, offsets, strict=False):
                starts[at : at + n] = True
            for ids in _hashed(codes, starts):
                ids = np.r_[ids, np.full(len(codes) - len(ids), BUCKETS, np.uint32)]
                added = np.stack([np.add.reduceat(column[ids], offsets[:-1]) for column in columns], 1)
                for (k, _, _), row in zip(waiting, added, strict=True):
                    out[k] += row
            waiting.clear()

    size = 0
    for k, text in enumerate(texts):
        codes = _codes(text)
        for at in range(0, len(codes), BLOCK):
            piece = codes[at : at + BLOCK + max(SIZES) - 1]
            waiting.append((k, piece, min(BLOCK, len(codes) - at)))
            size += len(piece)
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    return out


def predictions(model: Model | None, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether the score is high enough, of each text."""
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    sums = _sums(model, texts)
    p = model.scores(sums)
    some, best, at = sums[:, -1] > 0, p.max(1), p.argmax(1)
    langs = [model.langs[k] if ok else UNKNOWN for k, ok in zip(at.tolist(), some.tolist(), strict=True)]
    return langs, np.where(some, best, 0.0).tolist(), (some & (best >= model.accepted)).tolist()


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted (the score reaches the calibrated one) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            langs, scores, accepted = predictions(model, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang and score: as predict, with `und` where the score is not accepted."""
    p = predict(df, model, id_col, text_col)
    return p.select("doc_id", F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang"), "score")


def language_digest(docs: DataFrame) -> DataFrame:
    """Contract columns, and whether the score is accepted; a text with letters keeps its likeliest language either way."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
