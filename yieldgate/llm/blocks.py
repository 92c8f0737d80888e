"""Content-defined blocks: an index that says which documents can share a window of items.

Items are bytes or words, a window is `window` of them in a row. Each window is anchored at its least hashed k-gram, and
the windows of one anchor are a block: a stretch of the document that starts and ends where its contents say. So equal
windows lie in blocks with equal anchors, wherever they stand, and equal blocks have all their windows in common. There
is a block for every ten to twenty windows, which is what makes the shuffle small.

`index_blocks` gives two kinds of rows: `copied` blocks, which an earlier document holds as a whole, and `contested`
ones, those of the first document with their contents whose anchor has other contents too that agree on one side of it
as far as a window must reach there: only their windows need a closer look.

Equal blocks that a map task gathers together are settled there, so that a block, however frequent, brings one row to
the shuffle for every GATHER blocks read. Anchors that many blocks have are found on a sample of documents from everywhere in
the table and dealt out by contents; that decides only where a row goes, not what comes out. Spark sorts the blocks and
tasks compare them anchor by anchor; one with more blocks than a task should hold has them all contested.

Blocks are equal if 128 bits agree: 32 of the anchor's hash, 16 of each side's and 64 of the contents'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, GOLDEN, Rolling, chunks, forget, mix, raw_text, signed, word_hashes, words_of, written

#: Blocks that a map task gathers before it sends them on, and blocks that are compared at once.
GATHER, AT_ONCE = 1 << 18, 1 << 16
#: Most blocks of one anchor that are compared with each other.
HELD = 1 << 16
#: Documents of the sample for frequent anchors, on average; an anchor with this part of a partition's blocks is frequent.
SAMPLE_DOCS, FREQUENT = 2000, 1 / 32
#: Blocks for each shuffle partition at most, as the sample tells.
PART_BLOCKS = 1 << 20
_LOW = np.uint64(21)
_ROLL = Rolling(101)
_COPIED, _CONTESTED = 0, 1


@dataclass(frozen=True)
class Shape:
    """What items are, how many make a window, and how many make an anchor."""

    items: str  # "bytes" or "words"
    window: int
    anchor: int


def items_of(data: np.ndarray, offsets: np.ndarray, items: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of the items of all rows, and the rows' offsets in them."""
    if items == "bytes":
        return _BYTES[data], offsets
    starts, ends, counts = words_of(data, offsets)
    return word_hashes(data, starts, ends), np.r_[0, np.cumsum(counts)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of `width` values in a row."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def cut(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Blocks of all rows: row, first window (in its row), number of windows, anchor and sides, contents' hash."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < shape.window or n >= 1 << int(_LOW):
        if n >= 1 << int(_LOW):
            return _cut_long(values, offsets, shape)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = _ROLL.sums(values)
    starts = np.arange(n - shape.anchor + 1)
    grams = mix((sums[shape.anchor :] - sums[: -shape.anchor]) * _ROLL.inverses[: n - shape.anchor + 1])
    marked = (grams & ~np.uint64((1 << int(_LOW)) - 1)) | starts.astype(np.uint64)
    at = (sliding_min(marked, shape.window - shape.anchor + 1) & np.uint64((1 << int(_LOW)) - 1)).astype(np.int64)
    # Windows that lie in one row; at[i] is the anchor of the window at i.
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    good = np.arange(len(at)) + shape.window <= offsets[row + 1]
    new = good.copy()
    new[1:] &= ~good[:-1] | (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    many = np.add.reduceat(good.astype(np.int64), first)
    ends = first + many - 1 + shape.window
    contents = mix(_ROLL.slices(sums, first, ends) ^ (many.astype(np.uint64) * GOLDEN))
    # A window that begins `middle` items or less before its anchor reaches `right` items behind it, another one
    # `left` items before it; 16 bits of each go with the anchor's 32.
    place = at[first]
    middle = (shape.window - shape.anchor) // 2
    right, left = shape.window - shape.anchor - middle, middle + 1
    behind = np.minimum(place + shape.anchor, n - right)
    r = mix(_ROLL.slices(sums, behind, behind + right)) >> np.uint64(48)
    before = np.maximum(place - left, 0)
    l = mix(_ROLL.slices(sums, before, before + left)) >> np.uint64(48)  # noqa: E741
    r = np.where(first + many - 1 >= place - middle, r, contents >> np.uint64(48))
    l = np.where(first < place - middle, l, contents >> np.uint64(32) & np.uint64(0xFFFF))  # noqa: E741
    anchor = (grams[place] & ~np.uint64(0xFFFFFFFF)) | l << np.uint64(16) | r
    return row[first], first - offsets[row[first]], many, anchor, contents


def _cut_long(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """The same where the rows together are too long for one pass: each by itself, in overlapping parts.

    A part goes on from the first window that the part before has not finished, so blocks come out as in one pass.
    """
    out, most = [], (1 << int(_LOW)) - 1
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = a
        while at < b:
            to = min(b, at + most)
            _, lo, many, h, c = cut(values[at:to], np.array([0, to - at]), shape)
            keep = len(lo) if to == b or len(lo) < 2 else len(lo) - 1
            out.append((np.full(keep, row), lo[:keep] + (at - a), many[:keep], h[:keep], c[:keep]))
            if to == b or not len(lo):
                break
            at += int(lo[keep]) if keep < len(lo) else most
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_NAMES = ["anchor", "contents", "doc_id", "place"]
_ROWS_SQL = "anchor long, contents long, doc_id long, place long"
#: place holds the first window above these bits: the number of windows, whether the anchor is frequent, a known copy.
_MANY, _FREQUENT_BIT, _COPIED_BIT, _SHIFT = (1 << 14) - 1, 1 << 14, 1 << 15, 16
_UPPER = np.uint64(32)


def _settle(gathered: list[tuple[np.ndarray, ...]], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marks blocks whose contents a smaller document here has; they need no comparison and go wherever there is room."""
    anchor, contents, doc, lo, many = (np.concatenate(x) for x in zip(*gathered, strict=True))
    frequent = np.isin(anchor >> _UPPER, hot)
    # A frequent anchor's rows are dealt by contents.
    low = anchor & np.uint64(0xFFFFFFFF)
    key = np.where(frequent, mix(anchor >> _UPPER ^ contents) & ~np.uint64(0xFFFFFFFF) | low, anchor)
    order = np.lexsort((doc, contents, key))
    head = np.r_[True, (key[order][1:] != key[order][:-1]) | (contents[order][1:] != contents[order][:-1])]
    least = np.empty_like(doc)
    least[order] = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    copied = doc > least
    place = lo << _SHIFT | many | frequent * _FREQUENT_BIT | copied * _COPIED_BIT
    key = np.where(copied, mix(doc.astype(np.uint64)), key)
    contents = np.where(copied, np.uint64(0), contents)
    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(contents)), pa.array(doc), pa.array(place)], names=_NAMES)


def _map(batches: Iterator[pa.RecordBatch], shape: Shape, hot: list[int]) -> Iterator[pa.RecordBatch]:
    hot_keys, gathered, n = np.array(hot, np.uint64), [], 0
    for part in chunks(batches, "text"):
        row, lo, many, anchor, contents = cut(*items_of(*raw_text(part.column("text")), shape.items), shape)
        gathered.append((anchor, contents, part.column("doc_id").to_numpy(zero_copy_only=False)[row], lo, many))
        n += len(row)
        if n >= GATHER:
            yield from _settle(gathered, hot_keys)
            gathered, n = [], 0
    if n:
        yield from _settle(gathered, hot_keys)


def _count(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        anchor = cut(*items_of(*raw_text(part.column("text")), shape.items), shape)[3]
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor >> _UPPER))], names=["anchor"])


def sampled_anchors(docs: DataFrame, shape: Shape, parts: int) -> tuple[DataFrame, int]:
    """anchor, count over a sample of documents by a hash of their ids, and how many documents one of it stands for."""
    share = max(1, docs.count() // max(SAMPLE_DOCS, parts))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(97)), F.lit(share)) == 0)
    return written(sample.mapInArrow(partial(_count, shape=shape), "anchor long").groupBy("anchor").count(), "anchors"), share


def frequent_anchors(anchors: DataFrame, parts: int) -> list[int]:
    """Anchors with more than FREQUENT of a partition's share of a sample's blocks; parts / FREQUENT of them at most."""
    total = anchors.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in anchors.where(F.col("count") > max(20, total * FREQUENT / parts)).select("anchor").collect()]


_INDEX_SQL = "kind byte, key long, doc_id long, lo int, many int"


def _found(kind: int, key: np.ndarray, doc: np.ndarray, lo: np.ndarray, many: np.ndarray, alone: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, np.int8), pa.array(signed(key), mask=alone), doc, lo.astype(np.int32), many.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "doc_id", "lo", "many"])


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by their first column, `rows` or more at a time and never part of a group.

    But a group of more than `most` rows comes in parts, and true goes with each of them.
    """
    held: list[pa.RecordBatch] = []
    n, crowded = 0, None  # the key of the group whose parts are being given

    def split(last: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held, n, crowded
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        if crowded is not None:
            end = int(np.searchsorted(keys, crowded, "right"))
            if end:
                yield table.slice(0, end), True
            if end < len(keys) or last:
                crowded = None
            table, keys = table.slice(end), keys[end:]
        cut = len(keys) if last or not len(keys) else int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut), False
            table = table.slice(cut)
        if table.num_rows > most:
            crowded = keys[-1]
            yield table, True
            table = table.slice(table.num_rows)
        held, n = table.to_batches(), table.num_rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from split(False)
    if n:
        yield from split(True)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of earlier blocks, and contested first ones; rows come in the order of anchor, contents and document."""
    before = None  # the block that the last rows of a crowded anchor had, and its least document
    for rows, crowded in whole_groups(batches, AT_ONCE, HELD):
        _, anchor, contents, doc, place = (rows.column(k).to_numpy() for k in range(5))
        lo, many = place >> _SHIFT, place & _MANY
        settled = place & _COPIED_BIT > 0
        if settled.any():
            yield _found(_COPIED, anchor[settled].view(np.uint64) * np.uint64(0), doc[settled], lo[settled], many[settled])
            anchor, contents, doc, lo, many, place = (x[~settled] for x in (anchor, contents, doc, lo, many, place))
        if not len(anchor):
            continue
        anchor, contents = anchor.view(np.uint64), contents.view(np.uint64)
        head = np.r_[True, (anchor[1:] != anchor[:-1]) | (contents[1:] != contents[:-1])]
        least = doc[np.flatnonzero(head)]
        if before is not None and before[:2] == (anchor[0], contents[0]):
            least[0] = min(least[0], before[2])
        before = (anchor[-1], contents[-1], least[-1])
        copied = doc > least[np.cumsum(head) - 1]
        frequent = place & _FREQUENT_BIT > 0
        frequent |= crowded
        several = np.zeros(len(anchor), bool) if crowded else _several(anchor >> np.uint64(16), head) | _several(anchor & ~np.uint64(0xFFFF0000), head)
        contested = ~copied & (several | frequent)
        if copied.any():
            yield _found(_COPIED, anchor[copied] * np.uint64(0), doc[copied], lo[copied], many[copied])
        if contested.any():
            # Blocks of a frequent or crowded anchor have no key in common: null, and each of their windows goes its own way.
            yield _found(_CONTESTED, anchor[contested] >> _UPPER, doc[contested], lo[contested], many[contested], frequent[contested])


def _several(key: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Rows whose key has two different contents; head is true once for each contents."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.cumsum(new) - 1
    out = np.empty(len(key), bool)
    out[order] = np.bincount(group, head[order])[group] > 1
    return out


def partitions(df: DataFrame, rows: int = 0, each: int = 1) -> int:
    """As many shuffle partitions as the session asks for; more if `rows` need them to have `each` rows at most."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def index_blocks(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, int]:
    """Copied and contested blocks of docs (doc_id, text), and the number of partitions that they were dealt to.

    Blocks are doc_id, lo, many; contested ones have a key that equal windows share, too.
    """
    sample, share = sampled_anchors(docs, shape, partitions(docs))
    blocks = share * (sample.agg(F.sum("count")).first()[0] or 0)
    parts = partitions(docs, blocks, PART_BLOCKS)
    hot = frequent_anchors(sample, parts)
    forget(sample)
    rows = docs.mapInArrow(partial(_map, shape=shape, hot=hot), _ROWS_SQL)
    group = F.shiftrightunsigned("anchor", 32)
    in_order = rows.repartition(parts, group).sortWithinPartitions("anchor", "contents", "doc_id")
    # Groups in the order of signed anchors: the upper half goes before the lower one, and both rise.
    found = written(in_order.select(F.shiftright("anchor", 32).alias("group"), "*").mapInArrow(_compare, _INDEX_SQL), "blocks")
    contested = found.where(F.col("kind") == _CONTESTED).select("key", "doc_id", "lo", "many")
    contested.written_to = found.written_to  # for forget()
    return found.where(F.col("kind") == _COPIED).select("doc_id", "lo", "many"), contested, parts


def spans_by_doc(spans: DataFrame) -> DataFrame:
    """doc_id and its spans, as an array that the document's own length bounds."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "many")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str = "left") -> DataFrame:
    """docs with the spans of their id."""
    spans = spans_by_doc(spans).withColumnRenamed("doc_id", "span_doc")
    return docs.join(spans, docs["doc_id"] == spans["span_doc"], how).drop("span_doc")


def span_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and many of all spans of a column of lists."""
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def covered(offsets: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which items of all rows lie in a span; spans end with their row."""
    n = int(offsets[-1])
    begin = np.minimum(offsets[row] + lo, offsets[row + 1])
    end = np.minimum(begin + size, offsets[row + 1])
    marks = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def runs_of(row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and size of each run of windows that follow one another in one row; sorted."""
    new = np.r_[True, (np.diff(begin) != 1) | (np.diff(row) != 0)]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(begin)])
