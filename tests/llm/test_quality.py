from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from yieldgate.llm import quality


def features(t: str) -> dict:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def verdict(t: str) -> tuple[bool, bool]:
    f = features(t)
    failed = f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]
    letters = sum(c.isalpha() for c in t)
    bad = failed or not 15 * f["n_words"] <= 10 * f["word_chars"] <= 200 * f["n_words"] or 5 * f["n_symbols"] > f["word_chars"] or 2 * f["n_dup_lines"] > f["n_lines"] or 2 * letters < f["word_chars"] or 20 * t.count("�") > f["word_chars"]
    return failed, not bad


def test_digest(docs, empty, rows):
    got = sorted(map(tuple, quality.quality_digest(docs).collect()), key=str)
    want = []
    for i, t in rows:
        f = features(t or "")
        want.append((i, f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"], *verdict(t or "")))
    assert got == sorted(want, key=str)
    assert quality.quality_digest(empty).count() == 0


def test_kept_rows_are_as_they_were(docs, rows):
    kept = quality.keep_quality(docs)
    assert kept.schema == docs.schema
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, [r for r in rows if verdict(r[1] or "")[1]]))


def test_order_never_changes_the_verdict(docs):
    rules = quality.default_rules()[:4]
    want = None
    for order in itertools.islice(itertools.permutations(rules), 0, 24, 7):
        got = sorted(str(r[0]) for r in docs.where(quality.cascade(list(order), F.col("text"))).select("doc_id").collect())
        want = want or got
        assert got == want


def test_plan_puts_the_most_rejected_for_its_cost_first(spark):
    df = spark.createDataFrame([("few",), ("x " * 50,), ("y",)], "text string")
    plan = quality.plan_cascade(df, quality.default_rules())
    rates = [s / c for _, c, s in plan]
    assert rates == sorted(rates, reverse=True)
    assert {r.name: s for r, _, s in plan}["few_words"] == pytest.approx(2 / 3)
