from __future__ import annotations

import hashlib
from collections import defaultdict

from yieldgate.llm import sharding


def bits(key) -> int:
    return int(hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    """Depth of each row's shard, splitting full buckets one bit at a time."""
    out, todo = {}, [(0, list(range(len(rows))))]
    while todo:
        depth, held = todo.pop()
        if sum(len((rows[k][1] or "").encode()) for k in held) <= limit or len(held) == 1 or depth == sharding.BITS:
            out |= dict.fromkeys(held, depth)
            continue
        for bit in (0, 1):
            part = [k for k in held if bits(rows[k][0]) >> (sharding.BITS - depth - 1) & 1 == bit]
            if part:
                todo.append((depth + 1, part))
    return out


def test_digest(docs, empty, rows):
    for limit in (3000, 10**9):
        want = brute(rows, limit)
        got = sharding.shard_digest(docs, limit).collect()
        a = sorted((str(r["doc_id"]), r["n_bytes"], r["depth"]) for r in got)
        assert a == sorted((str(i), len((t or "").encode()), want[k]) for k, (i, t) in enumerate(rows))
        for r in got:
            assert r["shard"] == format(bits(r["doc_id"]), "060b")[: r["depth"]]
    assert sharding.shard_digest(empty).count() == 0


def test_rows_that_no_bit_parts_go_to_pages(spark):
    df = spark.createDataFrame([(7, "x" * 10)] * 9 + [(8, "y")], "doc_id long, text string")
    got = sharding.shard_digest(df, 25).collect()
    pages = defaultdict(int)
    for r in got:
        pages[(r["shard"], r["page"])] += r["n_bytes"]
    assert sum(pages.values()) == 91 and max(pages.values()) <= 25 and 6 <= len(pages) <= 10


def test_pages_of_large_and_small_rows(spark):
    sizes = [3, 40, 7, 100, 60, 20, 20, 1, 51, 50]
    df = spark.createDataFrame([(7, "x" * n) for n in sizes * 3], "doc_id long, text string").repartition(4)
    pages = defaultdict(list)
    for r in sharding.shard_digest(df, 100).collect():
        pages[r["page"]].append(r["n_bytes"])
    assert sorted(n for p in pages.values() for n in p) == sorted(sizes * 3)
    assert all(sum(p) <= 100 for p in pages.values()) and len(pages) <= 2 * sum(sizes) * 3 // 100 + 10


def test_a_directory_too_large_to_send(docs, monkeypatch):
    few = docs.where("doc_id < 17")
    want = sorted(map(str, sharding.shard_digest(few, 3000).select("doc_id", "shard").collect()))
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert sorted(map(str, sharding.shard_digest(few, 3000).select("doc_id", "shard").collect())) == want


def test_write(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 200_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
