"""Near-duplicate join on word 5-grams with Bayesian candidate pruning.

Documents with equal sets of 5-grams are one set, and only sets are compared. MinHash values in bands bring candidates
together: 32 bands of 4 miss a pair of similarity 0.8 with probability 5e-8. Within a band's group values are compared a
few at a time, and a pair is dropped when, given a uniform prior, the posterior probability that its similarity reaches
the threshold falls below `TOLERANCE`. What stays ties sets to clusters. Inside a cluster all pairs go through the same
test and the survivors are verified exactly, by the sizes of intersections.

Groups and clusters of any size are dealt in blocks: a task holds two blocks of at most a few hundred sets, and gives
for each set its number of links and one edge, never a pair of its own.

Defined results: a text of 1 to 4 words has one gram, all its words; a null or empty text has none, links to nothing and
is a class by itself; rows with the same id are versions of one document, each with its set (the least id of a set stands
for it, all versions of a document are in one class); null ids take no part in the join and get null classes; other
columns are kept out by name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import partitions
from .common import GOLDEN, chunks, documents, forget, gram_hashes, mix, raw_text, signed, word_hashes, words_of, written
from .components import components

WORDS = 5
#: The threshold 0.8, as a fraction so that no rounding decides.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: Values compared at once, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Sets in a block of a band's group, and in a block of a cluster.
GROUP_BLOCK, CLUSTER_BLOCK = 512, 192
#: Documents for each shuffle partition at most.
SETS = 20_000
#: Bits of the map that tells which documents' texts are wanted; 64 of them a broadcast row.
MAP_BITS = 1 << 24

_A = (mix(np.arange(1, VALUES + 1, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32)


def grams_of(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Different n-gram hashes of each row, sorted in each row, and the rows' offsets in them."""
    data, offsets = raw_text(column)
    starts, ends, counts = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    inner = np.r_[0, np.cumsum(counts)]
    grams = gram_hashes(words, n)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(grams))
    good = at + n <= inner[row[: len(at)] + 1] if len(at) else np.zeros(0, bool)
    rows, grams = row[: len(at)][good], grams[good]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([gram_hashes(words[inner[k] : inner[k + 1]], int(counts[k]), int(counts[k]))[0] for k in short], np.uint64)
        rows, grams = np.r_[rows, short], np.r_[grams, whole]
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    rows, grams = rows[new], grams[new]
    return grams, np.searchsorted(rows, np.arange(len(counts) + 1))


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each row that has grams, in their order."""
    first = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(first), VALUES), np.uint32)
    if len(first):
        x = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], first)
    return out


def set_keys(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order; first has the place of its first gram."""
    return np.add.reduceat(mix(grams), first), np.add.reduceat(mix(grams ^ GOLDEN), first)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        grams, offsets = grams_of(part.column("text"))
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        k1, k2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        sign: list[bytes | None] = [None] * len(size)
        if len(full):
            first = offsets[:-1][full]
            k1[full], k2[full] = set_keys(grams, first)
            values = signatures(grams, offsets)
            for r, k in enumerate(full.tolist()):
                sign[k] = values[r].tobytes()
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(size.astype(np.int32)), pa.array(sign, pa.binary())], names=["doc_id", "k1", "k2", "n", "sign"])


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band (a hash of its number and values) and set_id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            values = _matrix(part.column("sign"), np.uint32).astype(np.uint64).reshape(part.num_rows, BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, values.shape[:2])
            for k in range(ROWS):
                h = mix(h ^ values[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(h)).ravel()), pa.array(np.repeat(part.column("set_id").to_numpy(), BANDS))], names=["band", "set_id"])


@functools.lru_cache(maxsize=8)
def least_matches(tolerance: float = TOLERANCE) -> np.ndarray:
    """For 0, STEP, 2 STEP, ... values compared: the fewest matches with which a pair is not dropped.

    With m of n matches the posterior of the similarity is Beta(m + 1, n - m + 1); its weight above the threshold is the
    probability that a binomial of n + 1 trials at the threshold has m successes at most.
    """
    t, out = SIMILAR[0] / SIMILAR[1], [0]
    for n in range(STEP, VALUES + 1, STEP):
        below, m = (1 - t) ** (n + 1), 0
        term = below
        while below < tolerance:
            term *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
            below += term
        out.append(m)
    return np.array(out)


def likely(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of many can still be similar to one, comparing values step by step."""
    alive, matches, need = np.arange(len(many)), np.zeros(len(many), np.int64), least_matches()
    for k in range(1, len(need)):
        part = slice((k - 1) * STEP, k * STEP)
        matches = matches + (many[alive, part] == one[part]).sum(1)
        good = matches >= need[k]
        alive, matches = alive[good], matches[good]
        if not len(alive):
            break
    out = np.zeros(len(many), bool)
    out[alive] = True
    return out


class Forest:
    """Union of a task's rows; the least id of a tree is its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.r_[self.root[a], self.root[others]])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first `keys` columns, which stand together, one group at a time; groups span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and any(c[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py() for k, c in enumerate(cols))
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts.tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between sets of a band's group that the test lets pass; a spanning tree at most.

    Sets already tied to each other need no comparison.
    """
    a_out, b_out = [], []
    for group in groups_of(batches, 3):
        ids, block = group.column("set_id").to_numpy(), group.column("block").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], block[order]
        values = _matrix(group.column("sign").combine_chunks(), np.uint16)[order]
        forest = Forest(len(ids))
        crossing = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        for k in range(len(ids) - 1):
            rest = np.arange(k + 1, len(ids))
            rest = rest[forest.root[rest] != forest.root[k]]
            if crossing:
                rest = rest[block[rest] != block[k]]
            if len(rest) and len(rest := rest[likely(values[k], values[rest])]):
                forest.join(k, rest)
        tied = np.flatnonzero(forest.root != np.arange(len(ids)))
        a_out.append(ids[tied])
        b_out.append(ids[forest.root[tied]])
        if len(a_out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out)], names=["a", "b"])
            a_out, b_out = [], []
    if a_out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out)], names=["a", "b"])


def _in_blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df (key, set_id, n_sets, ...) with columns i <= j and block: every two blocks of a key meet in one (key, i, j)."""
    n_blocks = F.ceil(F.col("n_sets") / size).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(7)), n_blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    df = df.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rest = [c for c in df.columns if c not in (key, "i", "j", "other", "n_sets")]
    return df.select(key, "i", "j", *rest)


def _together(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j")


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, n_sets, set_id, values (16 bits each) and grams of each set; other versions of its document go."""
    for part in chunks(batches, "text"):
        grams, offsets = grams_of(part.column("text"))
        same = np.zeros(part.num_rows, bool)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            k1, k2 = set_keys(grams, offsets[:-1][full])
            same[full] = (signed(k1) == part.column("k1").to_numpy()[full]) & (signed(k2) == part.column("k2").to_numpy()[full])
        if not same.all():
            grams, size = grams[np.repeat(same, np.diff(offsets))], np.diff(offsets)[same]
            offsets, part = np.r_[0, np.cumsum(size)], part.filter(pa.array(same))
        values = signatures(grams, offsets).astype(np.uint16)
        bodies = [grams[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("n_sets"), part.column("set_id"), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(bodies, pa.binary())], names=["cluster", "n_sets", "set_id", "sign", "grams"])


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all of a with all of b, by a product of incidence matrices, some grams at a time."""
    grams, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out, width = np.zeros((len(a), len(b)), np.float64), max(1, (1 << 22) // (len(a) + len(b)))
    for low in range(0, len(grams), width):
        part = slice(*np.searchsorted(at, [low, low + width]))
        cells = np.zeros((len(a) + len(b), width), np.float32)
        cells[row[part], at[part] - low] = 1
        out += cells[: len(a)] @ cells[len(a) :].T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id, links, root: for two blocks of a cluster, each set's number of links and the least set it is tied to."""
    for group in groups_of(batches, 3):
        ids, order = np.unique(group.column("set_id").to_numpy(), return_index=True)  # rows repeated under one id count once
        block = group.column("block").to_numpy()[order]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        values = _matrix(group.column("sign").combine_chunks(), np.uint16)[order]
        bodies = group.column("grams").to_pylist()
        sets = [np.frombuffer(bodies[k], np.uint64) for k in order]
        left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(ids)),) * 2
        alive = np.array([likely(values[k], values[right]) for k in left]).reshape(len(left), len(right))
        if i == j:
            np.fill_diagonal(alive, False)
        rows, cols = alive.any(1), alive.any(0)
        if not rows.any():
            continue
        left, right, alive = left[rows], right[cols], alive[rows][:, cols]
        size = np.array([len(s) for s in sets])
        both = shared([sets[k] for k in left], [sets[k] for k in right])
        union = size[left][:, None] + size[right][None, :] - both
        linked = alive & (both * SIMILAR[1] >= union * SIMILAR[0])
        links = np.bincount(left, linked.sum(1), len(ids)).astype(np.int64)
        if i != j:
            links += np.bincount(right, linked.sum(0), len(ids)).astype(np.int64)
        forest = Forest(len(ids))
        for k, others in zip(left, linked, strict=True):
            if others.any():
                forest.join(int(k), right[others])
        tied = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(links[tied]), pa.array(ids[forest.root[tied]])], names=["set_id", "links", "root"])


def set_members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n) for every document, and for every set with grams sid, set_id, sign and its keys.

    sid tells sets apart, as set_id (the least document with the set) need not if a document has versions: it is set_id
    for one set of each document, and a number above all ids for its other ones.
    """
    sets = written(docs.mapInArrow(_sets, "doc_id long, k1 long, k2 long, n int, sign binary"), "sets")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("set_id"), F.min_by("sign", "doc_id").alias("sign"))
    reps = written(reps.withColumn("other", F.lit(1 << 62) + F.monotonically_increasing_id()), "classes")
    keys = written(sets.drop("sign"), "keys")
    forget(sets)
    twice = reps.groupBy("set_id").agg(F.min("other").alias("first"), F.count("*").alias("versions")).where("versions > 1").drop("versions")
    sid = F.when(F.col("first") != F.col("other"), F.col("other")).otherwise(F.col("set_id"))
    out = written(reps.join(twice, "set_id", "left").select(sid.alias("sid"), "set_id", "k1", "k2", "n", "sign"), "reps")
    forget(reps)
    return keys, out


def _wanted(docs: DataFrame, ids: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """docs without most of those whose doc_id is not in ids (doc), so that a join need not shuffle their texts.

    A bit for each hash of a wanted id, in a table of at most bits / 64 rows that is broadcast whatever the input; where
    more ids are wanted than there are bits, all documents go to the join, which decides.
    """
    at = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(11)), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_h & 63 as int))")
    words = ids.select(at("doc").alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = docs.withColumn("_h", at("doc_id")).withColumn("_word", F.shiftright("_h", 6))
    return marked.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(*docs.columns)


def similar_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """sid, n_links, component (a sid) for each set that has a link or versions; reps as from set_members()."""
    parts = partitions(docs, docs.count(), SETS)
    bands = reps.select(F.col("sid").alias("set_id"), "sign").mapInArrow(_bands, "band long, set_id long")
    crowded = bands.groupBy("band").agg(F.count("*").alias("n_sets")).where("n_sets > 1")
    short = reps.select(F.col("sid").alias("set_id"), "sign").mapInArrow(_shorter, "set_id long, sign binary")
    met = bands.join(crowded, "band").join(short, "set_id")
    groups = _together(_in_blocks(met.select("band", "set_id", "n_sets", "sign"), "band", GROUP_BLOCK), "band", parts)
    clusters = components(groups.mapInArrow(_tie, "a long, b long"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n_sets"))
    members = clusters.join(sizes, "component").select(F.col("node").alias("sid"), F.col("component").alias("cluster"), "n_sets")
    members = written(members.join(reps.select("sid", F.col("set_id").alias("doc"), "k1", "k2"), "sid"), "clusters")
    near = _wanted(docs, members)
    texts = near.join(members, near["doc_id"] == members["doc"]).select("cluster", "n_sets", F.col("sid").alias("set_id"), "k1", "k2", "text")
    grams = texts.mapInArrow(_with_grams, "cluster long, n_sets long, set_id long, sign binary, grams binary")
    pairs = _together(_in_blocks(grams, "cluster", CLUSTER_BLOCK), "cluster", parts)
    found = written(pairs.mapInArrow(_verify, "set_id long, links long, root long"), "links")
    forget(clusters, members)
    versions = reps.where("sid <> set_id").select(F.col("sid").alias("a"), F.col("set_id").alias("b"))
    groups = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")).unionByName(versions))
    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    out = groups.join(links, links["set_id"] == groups["node"], "left").select(F.col("node").alias("sid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component")
    out = written(out, "linked")
    forget(found, groups)
    return out


def _shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low 16 bits of each value, which is what pairs are compared by."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            values = _matrix(part.column("sign"), np.uint32).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array([v.tobytes() for v in values], pa.binary())], names=["set_id", "sign"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_id (least id with the same grams), class_id (least id of those tied by links), n_links (other sets)."""
    docs = documents(df, id_col, text_col)
    sets, reps = set_members(docs)
    found = similar_sets(docs.where("doc_id IS NOT NULL"), reps)
    classes = reps.select("sid", "k1", "k2", "n", "set_id").join(found, "sid", "left")
    classes = classes.select("k1", "k2", "n", "set_id", F.coalesce("component", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = written(classes, "members")
    full = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "k1", "k2", "n").join(classes, ["k1", "k2", "n"])
    forget(reps, found)
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", "set_id", "class_id", "n_links").unionByName(alone)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the documents of a class but its least; a row repeated under one id stays once, rows without id all stay."""
    classes = near_duplicates(df, id_col, text_col)
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    same = lambda t, c: F.col(id_col).cast("long") == t[c]
    kept = df.join(gone, same(gone, "gone"), "left_anti")
    twice = written(classes.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same(twice, "twice"), "left_anti")
    return once.unionByName(kept.join(twice, same(twice, "twice"), "left_semi").dropDuplicates([id_col, text_col]))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)) AS g FROM d),
sets AS (SELECT g, min(doc_id) AS set_id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
grams AS (SELECT set_id, n, unnest(g) AS g FROM sets),
pairs AS (SELECT a.set_id AS a, b.set_id AS b, a.n + b.n - count(*) AS u, count(*) AS i
          FROM grams a JOIN grams b ON a.g = b.g AND a.set_id <> b.set_id GROUP BY a.set_id, b.set_id, a.n, b.n
          HAVING {SIMILAR[1]} * count(*) >= {SIMILAR[0]} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT s.doc_id, coalesce(sets.set_id, s.doc_id) AS set_id, coalesce(least(least.b, sets.set_id), sets.set_id, s.doc_id) AS class_id,
       coalesce(links.n, 0) AS n_links
FROM s LEFT JOIN sets ON s.g = sets.g LEFT JOIN least ON least.a = sets.set_id LEFT JOIN links ON links.a = sets.set_id
"""
