"""Every stage against a brute-force version, on what the stage before it kept."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from test_bayes import brute as brute_classes
from test_quality import verdict
from test_repeats import as_bytes
from test_repeats import brute as brute_repeats
from test_secrets import spans
from tokenizers import Tokenizer

import corpus_pipeline
from yieldgate.llm import secrets


def masked(t: str) -> str:
    out, at = "", 0
    for a, _, b, _ in spans(t, secrets.RULES):
        if a >= at:
            out += t[at:a] + secrets.MASK
        at = max(at, b)
    return out + t[at:]


def test_stages(spark, rows, tmp_path, vocab_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    now, docs = list(rows), table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name == "quality_rules":
            now = [r for r in now if verdict(r[1] or "")[1]]
        elif name == "near_duplicates":
            classes = brute_classes(now)
            now = list(dict.fromkeys(r for r in now if classes[r][1] == r[0]))
        elif name == "repeated_passages":
            now = [(i, bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore")) for i, x, gone in brute_repeats(now, 50, as_bytes)]
        elif name == "masked_secrets":
            now = [(i, masked(t)) for i, t in now]
        if name != "packed":
            assert docs.columns == table.columns
            assert sorted(map(str, [(r["doc_id"], r["text"]) for r in docs.collect()])) == sorted(map(str, now))
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(vocab_path)
    sizes: Counter = Counter()
    for r in docs.collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in now})
    assert re.fullmatch("packed", corpus_pipeline.STAGES[-1][0])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
