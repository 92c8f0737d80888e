"""Substring dedup by a distributed difference-cover sort.

Which bytes of a document lie in a 50-byte string that also starts in an earlier document? `index_blocks` first settles
what whole content-defined blocks tell and leaves contested ones. Of their strings those stay whose hash another
document has too; hashes only rule strings out. The rest is decided by sorting bytes across the cluster:

Positions 1 and 2 modulo 3 of a document are the sample. Each brings a triple of letters, (length - 2) / 3 bytes a
letter, and up to two bytes on each side. Spark sorts the triples by range partitions, and equal neighbours have one
name. Two strings, wherever they start, reach sampled positions after the same 0, 1 or 2 bytes (that is what makes 1 and
2 a difference cover), so they are equal if the bytes before these, the names and the bytes behind the triples are:
that merges the strings at all positions in one walk along the sorted sample, comparing neighbours. As a triple and two
bytes are the whole string, the names of the first sort are final and there is nothing to recurse on.

Defined results: a null or empty text is kept as it is; documents shorter than the length lose nothing; rows with the
same id are versions of one document (nothing is removed on account of another version, and a span found in one is cut
from all, as far as they reach) and null ids take no part; of equal
texts the one with the least id stays; other columns are kept out by name.
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
from pyspark.sql import types as T

from .blocks import Shape, covered, index_blocks, runs_of, span_lists, whole_groups, with_spans
from .common import _BYTES, Rolling, chunks, documents, forget, mix, raw_text, signed, written

LENGTH = 50
ANCHOR = 12
_ROLL = Rolling(211)
#: Contested blocks that are looked at together, and most of one key.
BLOCKS, HELD = 1 << 14, 1 << 17
#: Bytes of text that are cut into samples at once, and samples that are compared at once.
CUT_BYTES, SAMPLES = 1 << 18, 1 << 16
#: Positions modulo 3 that are sampled, and the bytes by which strings at any two positions are shifted into the sample.
COVER, SHIFTS = (1, 2), (0, 1, 2)


def shape(length: int = LENGTH) -> Shape:
    return Shape("bytes", length, min(ANCHOR, length))


def known_copies(hashes: np.ndarray, doc: np.ndarray, data: np.ndarray, begin: np.ndarray, width: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Which strings of data a smaller document here has too, with the same sides: found by hash, compared by bytes."""
    order = np.lexsort((doc, hashes))
    new = np.r_[True, np.diff(hashes[order]) != 0][: len(order)]
    model = np.empty_like(order)
    model[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = doc > doc[model] if sides is None else (doc > doc[model]) & (sides == sides[model])
    at, step = np.flatnonzero(out), np.arange(width)
    for k in range(0, len(at), SAMPLES):
        some = at[k : k + SAMPLES]
        out[some] = (data[begin[some][:, None] + step] == data[begin[model[some]][:, None] + step]).all(1)
    return out


def spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers that deal rows out evenly."""
    return mix(doc.astype(np.uint64) << np.uint64(24) ^ place.astype(np.uint64))


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contested blocks' bytes: key, doc_id, lo, body. Without a key each window is a body; known copies have none."""
    for part in chunks(batches, "text"):
        data, offsets = raw_text(part.column("text"))
        row, lo, many = span_lists(part.column("spans"))
        keys = part.column("spans").flatten().field(2)
        alone = keys.is_null().to_numpy(zero_copy_only=False)
        keys = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
        fits = offsets[row] + lo + many + length - 1 <= offsets[row + 1]
        row, lo, many, alone, keys = (x[fits] for x in (row, lo, many, alone, keys))
        # Frequent anchors: a row for each window.
        size = np.where(alone, many, 1)
        lo = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, many, keys, alone = np.repeat(row, size), np.repeat(np.where(alone, 1, many), size), np.repeat(keys, size), np.repeat(alone, size)
        begin, sizes = offsets[row] + lo, many + length - 1
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
        if alone.any():
            hashes = mix(_ROLL.slices(_ROLL.sums(_BYTES[data]), begin, begin + sizes))
            at = np.flatnonzero(alone)
            known = at[known_copies(hashes[at], doc[at], data, begin[at], length)]
            sizes[known] = 0
            hashes[known] = spread(doc[known], lo[known])
            keys = np.where(alone, signed(hashes), keys)
        inner = np.r_[0, np.cumsum(sizes)]
        at = np.arange(inner[-1]) + np.repeat(begin - inner[:-1], sizes)
        body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(inner.astype(np.int32)), pa.py_buffer(data[at])])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(doc), pa.array(lo.astype(np.int32)), body], names=["key", "doc_id", "lo", "body"])


def _candidates(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs (doc_id, lo, body) of strings whose hash two documents have under one key; known copies as they come.

    Of a key with too many blocks to look at together all strings are candidates.
    """
    for rows, crowded in whole_groups(batches, BLOCKS, HELD):
        key, doc, lo = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
        data, offsets = raw_text(rows.column(3).combine_chunks().cast(pa.large_binary()))
        size = np.diff(offsets)
        many = np.maximum(size - (length - 1), 0)
        row = np.repeat(np.arange(len(doc)), many)
        begin = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
        if crowded:
            hit = np.ones(len(row), bool)
        else:
            hashes = mix(_ROLL.slices(_ROLL.sums(_BYTES[data]), begin, begin + length) ^ mix(key.view(np.uint64))[row])
            order = np.argsort(hashes)
            new = np.r_[True, np.diff(hashes[order]) != 0][: len(order)]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            owner = doc[row[order]]
            hit = np.zeros(len(row), bool)
            if len(order):
                hit[order] = (np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first))[group]
        row, begin = row[hit], begin[hit]
        if len(row):
            first, run = runs_of(row, begin)
            yield _bodies(doc[row[first]], (lo - offsets[:-1])[row[first]] + begin[first], data, begin[first], run + length - 1)
        known = size == 0
        if known.any():
            yield _bodies(doc[known], lo[known], data, offsets[:-1][known], size[known])


def _bodies(doc: np.ndarray, lo: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """doc_id, lo, body: slices of data."""
    inner = np.r_[0, np.cumsum(size)]
    at = np.arange(inner[-1]) + np.repeat(begin - inner[:-1], size)
    body = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(inner.astype(np.int32)), pa.py_buffer(data[at])])
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), body], names=["doc_id", "lo", "body"])


_SAMPLE_SQL = "text binary, doc_id long, place int, sides long"
#: Above these bits of sides: how many bytes there are before and behind the triple, and whether an earlier document is
#: known to have it with the same ones; below, the bytes: nearest and next before, nearest and next behind.
_COUNTS = 32


def _samples(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The sampled triples of runs, with up to two bytes on each side.

    Those that a smaller document of the same chunk has with the same sides, byte by byte, need no comparison and go
    wherever there is room, so that a triple brings no more rows to one task than there are chunks.
    """
    span = length - 2
    for part in chunks(batches, "body", CUT_BYTES):
        doc, lo = part.column("doc_id").to_numpy(), part.column("lo").to_numpy().astype(np.int64)
        data, offsets = raw_text(part.column("body").cast(pa.large_binary()))
        many = np.maximum(np.diff(offsets) - span + 1, 0)
        copies = np.flatnonzero(many == 0)
        if len(copies):
            away = spread(doc[copies], lo[copies])
            yield _sampled(away.view(np.uint8).reshape(-1, 8), span, doc[copies], lo[copies], np.full(len(copies), (2 << 2 | 1 << 4) << _COUNTS))
        row = np.repeat(np.arange(len(doc)), many)
        begin = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
        place = begin - offsets[row] + lo[row]
        sampled = np.isin(place % 3, COVER)
        row, begin, place = row[sampled], begin[sampled], place[sampled]
        if not len(row):
            continue
        doc = doc[row]
        before, behind = np.minimum(2, begin - offsets[row]), np.minimum(2, offsets[row + 1] - begin - span)
        wide = np.r_[np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)].astype(np.int64)
        sides = wide[begin + 1] * (before > 0) | wide[begin] * (before > 1) << 8 | wide[begin + span + 2] * (behind > 0) << 16 | wide[begin + span + 3] * (behind > 1) << 24
        sides |= (before | behind << 2) << _COUNTS
        text = data[begin[:, None] + np.arange(span)]
        hashes = mix(_ROLL.slices(_ROLL.sums(_BYTES[data]), begin, begin + span) ^ mix(sides.view(np.uint64)))
        known = known_copies(hashes, doc, data, begin, span, sides)
        sides |= known.astype(np.int64) << _COUNTS + 4
        away = spread(doc[known], place[known]).view(np.uint8).reshape(-1, 8)[:, :span]
        text[known, : away.shape[1]] = away
        yield _sampled(text, span, doc, place, sides)


def _sampled(text: np.ndarray, span: int, doc: np.ndarray, place: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    if text.shape[1] != span:
        text = np.pad(text[:, :span], ((0, 0), (0, max(0, span - text.shape[1]))))
    ends = np.arange(0, span * len(doc) + 1, span, dtype=np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text))])
    return pa.RecordBatch.from_arrays([flat, pa.array(doc), pa.array(place.astype(np.int32)), pa.array(sides)], names=["text", "doc_id", "place", "sides"])


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of strings that a smaller document has too, from samples in the order of triple and document."""
    span = length - 2
    carried: tuple[bytes, dict[int, int]] = (b"", {})  # a crowded triple and, for its sides, the least document so far
    for rows, crowded in whole_groups(batches, SAMPLES, SAMPLES):
        text = raw_text(rows.column(0).combine_chunks().cast(pa.large_binary()))[0].reshape(-1, span)
        doc, place, sides = rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy()
        before, behind, known = sides >> _COUNTS & 3, sides >> _COUNTS + 2 & 3, sides >> _COUNTS + 4 & 1 > 0
        name = np.cumsum(np.r_[False, (text[1:] != text[:-1]).any(1)])
        keys, docs, starts, sure = [], [], [], []
        for d in SHIFTS:
            near = (sides >> 16 & 0xFFFF, sides & 0xFF | sides >> 8 & 0xFF00, sides & 0xFFFF)[d]
            fits = (before >= d) & (behind >= 2 - d)
            keys.append((name << 18 | d << 16 | near)[fits])
            docs.append(doc[fits])
            starts.append((place - d)[fits])
            sure.append(known[fits])
        key, owner, start, sure = (np.concatenate(x) for x in (keys, docs, starts, sure))
        hit = sure.copy()
        key, asked = key[~sure], np.flatnonzero(~sure)
        if len(key):
            order = np.lexsort((owner[asked], key))
            head = np.r_[True, np.diff(key[order]) != 0]
            least = owner[asked][order][np.flatnonzero(head)]
            if crowded:
                label = rows.column(0)[0].as_py()
                if carried[0] != label:
                    carried = (label, {})
                for k, at in enumerate(key[order][head].tolist()):
                    least[k] = carried[1][at] = min(int(least[k]), carried[1].get(at, int(least[k])))
            hit[asked[order]] = owner[asked][order] > least[np.cumsum(head) - 1]
        owner, start = owner[hit], start[hit]
        if len(owner):
            order = np.lexsort((start, owner))
            owner, start = owner[order], start[order]
            new = np.r_[True, (np.diff(owner) != 0) | (np.diff(start) != 0)]
            owner, start = owner[new], start[new]
            first, size = runs_of(owner, start)
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(start[first].astype(np.int32)), pa.array(size.astype(np.int32))], names=["doc_id", "lo", "many"])


def repeated_strings(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """Spans (doc_id, lo, many) of starts of strings in runs (doc_id, lo, body) that start in a smaller document's too.

    runs are read twice, the first time for the bounds of the ranges by which Spark sorts.
    """
    samples = runs.mapInArrow(partial(_samples, length=length), _SAMPLE_SQL)
    in_order = samples.repartitionByRange(parts, "text").sortWithinPartitions("text", "doc_id")
    return in_order.mapInArrow(partial(_repeats, length=length), "doc_id long, lo int, many int")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (doc_id, lo, many) of starts of repeated strings, in docs (doc_id, text)."""
    if length < 4:
        raise ValueError("strings of fewer than four bytes have no triples")
    copied, contested, parts = index_blocks(docs.where("doc_id IS NOT NULL"), shape(length))
    lists = contested.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "many", "key")).alias("spans"))
    lists = lists.withColumnRenamed("doc_id", "span_doc")
    bodies = docs.join(lists, docs["doc_id"] == lists["span_doc"]).select("doc_id", "text", "spans")
    bodies = bodies.mapInArrow(partial(_cut_out, length=length), "key long, doc_id long, lo int, body binary")
    # A key's strings meet in one task; of a frequent anchor, whose blocks have keys of their own, each string goes alone.
    met = bodies.repartition(parts, "key").sortWithinPartitions("key")
    runs = written(met.mapInArrow(partial(_candidates, length=length), "doc_id long, lo int, body binary"), "runs")
    # Written, so that what led to them can go before texts are dealt out again.
    spans = written(copied.unionByName(repeated_strings(runs, length, parts)), "spans")
    forget(contested, runs)
    return spans


def _keep(batches: Iterator[pa.RecordBatch], length: int, text_out: bool) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        data, offsets = raw_text(part.column("text"))
        row, lo, many = span_lists(part.column("spans"))
        gone = covered(offsets, row, lo, many + length - 1)
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        rise[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
        removed, runs = (np.r_[0, np.cumsum(x)] for x in (gone, rise))
        removed, runs = np.diff(removed[offsets]), np.diff(runs[offsets])
        kept, at = data[~gone].tobytes(), np.r_[0, np.cumsum(np.diff(offsets) - removed)]
        pieces = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if text_out:
            texts = pa.array([p.decode("utf-8", "ignore") if n else "" for p, n in zip(pieces, removed.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(removed), texts, part.column("row")], names=["n_removed", "text", "row"])
        else:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(p).hexdigest() for p in pieces])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contract columns for every document."""
    docs = documents(docs)
    spans = repeated_spans(docs, length)
    return with_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(partial(_keep, length=length, text_out=False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated bytes taken out of its texts (bytes of cut characters go too); null ids and texts stay."""
    docs = documents(df, id_col, text_col)
    spans = repeated_spans(docs, length)
    body = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    joined = with_spans(body, spans).select("row", "doc_id", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"), "spans")
    schema = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), joined.schema["row"]])
    cut = joined.mapInArrow(partial(_keep, length=length, text_out=True), schema)
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col(f"row.`{text_col}`"))
    return cut.select(*(text.alias(n) if n == text_col else F.col(f"row.`{n}`").alias(n) for n in df.columns))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS g
      FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - {LENGTH - 1})) AS i FROM d WHERE length(x) >= {2 * LENGTH})),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, {LENGTH}) r(k)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < i - 1) AS n_spans
         FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
byte AS (SELECT d.doc_id, substr(x, 2 * i + 1, 2) AS b, i FROM d JOIN runs USING (doc_id), LATERAL (SELECT unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS i)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS x FROM byte ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
