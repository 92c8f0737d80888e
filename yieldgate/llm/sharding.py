"""Sharding by extendible hashing.

A row's key is hashed once; a shard is a prefix of the hash bits. All rows start in the one shard of depth 0, and only
shards above the byte limit split on their next bit, until each fits. The directory, indexed by prefixes, has one entry a
shard; a row looks up its prefixes of the depths that occur.

Defined results: rows with equal keys have equal hashes and no bit can part them; if such rows alone pass the limit,
they are laid in turn on overflow pages of their shard: small ones on even pages, each of which is filled from half
the limit's multiples, those above half the limit on odd pages by themselves; so no page passes the limit unless a
single row does. A row larger than the limit is a shard by itself. Null keys are one key; null texts count no bytes; an empty table gives an empty directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.plans.shared import running_sums

from .common import written

#: Hash bits used: 60, as 15 hexadecimal digits of an MD5, which any engine can compute.
BITS = 60
LIMIT = 1 << 20
#: Rows of a histogram or directory that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", bits, F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth))


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shards (depth, prefix, shard_bytes, shard_rows) for rows with columns `bits` and `n_bytes`.

    The rows are read once, into a histogram about six bits finer than the shards expected; sums of all prefixes come
    from the histogram alone, and a shard is a prefix that fits below one that does not. Only cells that no bit of the
    histogram makes fit are counted again, finer.
    """
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(6, (int(total) // max(1, limit)).bit_length() + 4)
    rows, start, shards = sized, 0, None
    while True:
        fine = min(BITS, start + step)
        cells = written(rows.groupBy(prefix(F.col("bits"), fine).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), "histogram")
        each = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(fine))))
        cut = F.call_function("shiftright", F.col("cell"), F.lit(fine) - F.col("depth"))
        sums = written(each.groupBy("depth", cut.alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows")), "prefixes")
        whole = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        over = sums.where(~whole).select("depth", "prefix")
        below = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        fits = sums.where(whole)
        closed = fits.where(F.col("depth") == start).unionByName(fits.where(F.col("depth") > start).join(below, ["depth", "prefix"]))
        shards = closed if shards is None else shards.unionByName(closed)
        again = over.where(F.col("depth") == fine).select(F.col("prefix").alias("cell"))
        if not (n := again.count()):
            return shards.select("depth", "prefix", "shard_bytes", "shard_rows")
        rows = rows.join(_small(again, n), prefix(F.col("bits"), fine) == again["cell"], "left_semi")
        start, step = fine + 1, 12


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def assign_shards(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """df with a struct column `shard` (id, depth, page, bytes, rows); an older column of that name is replaced."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if size is None else size
    rows = df.drop("shard").select(F.struct("*").alias("row"), hash_bits(F.col(key)).alias("bits"), size.alias("n_bytes"))
    shards = written(directory(rows.select("bits", "n_bytes"), limit), "directory")
    ends = shards.agg(F.min("depth"), F.max("depth"), F.count("*")).first()
    least, deepest, n = ends[0] or 0, ends[1] or 0, ends[2]
    # Rows and shards meet by the bits that all shards have; of the shards there a row takes the one that is its prefix.
    coarse = shards.withColumn("coarse", F.call_function("shiftright", F.col("prefix"), F.col("depth") - F.lit(least)))
    here = (prefix(F.col("bits"), least) == F.col("coarse")) & (prefix(F.col("bits"), F.col("depth")) == F.col("prefix"))
    placed = rows.join(_small(coarse, n), here).drop("coarse")
    label = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    page = F.lit(0).cast("long")
    if deepest == BITS:
        # Only rows that no bit can part are ordered, by ranges, and only within their own shard.
        crowded = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
        large, half = F.col("n_bytes") * 2 > limit, max(1, limit // 2)
        order = [F.xxhash64(F.to_json("row"))]
        sums = {"_small": F.when(large, 0).otherwise(F.col("n_bytes")), "_large": large.cast("long")}
        full = running_sums(placed.where(crowded), order, sums, ["prefix"])
        turn = F.when(large, F.col("_large") * 2 - 1).otherwise(F.floor((F.col("_small") - F.col("n_bytes")) / half) * 2)
        full = full.withColumn("page", turn.cast("long")).drop("_small", "_large")
        placed = placed.where(~crowded).withColumn("page", page).unionByName(full)
    else:
        placed = placed.withColumn("page", page)
    shard = F.struct(label.alias("id"), F.col("depth").cast("int").alias("depth"), F.col("page").alias("page"), F.col("shard_bytes").alias("bytes"), F.col("shard_rows").alias("rows"))
    return placed.select("row.*", shard.alias("shard"))


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Files of path/shard_id=.../page=...; each shard is written by one task and fits the limit."""
    out = assign_shards(df, key, limit=limit)
    out = out.withColumns({"shard_id": F.concat(F.lit("p"), F.col("shard.id")), "page": F.col("shard.page")}).drop("shard")
    out.repartition("shard_id", "page").write.partitionBy("shard_id", "page").parquet(path)


def shard_digest(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, page, shard_bytes, shard_rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = assign_shards(slim, "doc_id", F.col("n_bytes"), limit)
    return out.select("doc_id", "n_bytes", F.col("shard.id").alias("shard"), F.col("shard.depth").alias("depth"), F.col("shard.page").alias("page"), F.col("shard.bytes").alias("shard_bytes"), F.col("shard.rows").alias("shard_rows"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits
  FROM documents),
p AS (SELECT doc_id, n_bytes, bits, k AS depth, bits >> ({BITS} - k) AS prefix FROM d, range(0, 31) r(k)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.n_bytes, p.bits, p.depth, p.prefix, s.shard_bytes, s.shard_rows,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {LIMIT} OR s.shard_rows = 1 OR depth = 30)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, shard_bytes, shard_rows
FROM f WHERE k = 1
"""
