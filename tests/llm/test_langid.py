from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from yieldgate.llm import langid

SYLLABLES = {"aa": "ka ro mi tu ne".split(), "bb": "scht ein ung pfe ich".split(), "cc": "ção não lhe eiro em".split()}
SF = "/root/testdata/sf0.01/documents.parquet"


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, lang, rng.choice([1, 3, 30, 200])), lang) for k in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (None, rows[0][1], rows[0][2]), (1003, text(rng, "bb", 60_000), None), (1004, rows[5][1], None), (1004, rows[5][1], None), (1005, "漢字", None)]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)


def held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_digest(table):
    got = langid.language_digest(table).collect()
    rows = {r["doc_id"]: r for r in table.collect()}
    assert len(got) == table.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"] and by_id[1002]["score"] == 0 and not by_id[1002]["accepted"]
    assert by_id[1004]["score"] == by_id[5]["score"] and by_id[1005]["lang_pred"] in SYLLABLES
    judged = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert len(judged) > 80 and np.mean(judged) > 0.97


def test_same_model_however_the_table_is_split(table):
    a, b = langid.fit(table), langid.fit(table.repartition(1).sortWithinPartitions("text"))
    assert (a.embeddings == b.embeddings).all() and (a.weights == b.weights).all() and (a.temperature, a.accepted) == (b.temperature, b.accepted)


def test_held_out_and_unlabelled_documents_are_not_learned_from(table):
    taken = langid.sample(table).collect()
    may = {(r["text"] or "")[: langid.SAMPLE_CHARS] for r in table.collect() if r["doc_id"] is not None and not held(r["doc_id"]) and r["lang"] is not None}
    assert taken and {r["text"] for r in taken} <= may


def test_nothing_to_learn_from(table):
    got = langid.language_digest(table.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and {r["score"] for r in got} == {0.0}
    assert langid.language_digest(table.where("1 = 0")).count() == 0
    one = langid.language_digest(table.withColumn("lang", langid.F.lit("aa"))).collect()
    assert {r["lang_pred"] for r in one if r["doc_id"] in (1, 2, 3)} == {"aa"}


def test_blocks_add_up(monkeypatch):
    rng = random.Random(6)
    texts = [text(rng, "bb", n) for n in (1, 5000, 0, 40, 3)] + ["Ärger, O'Neil x y"]
    model = langid.Model(["p", "q"], np.random.default_rng(0).normal(size=(langid.BUCKETS, 4)), np.random.default_rng(1).normal(size=(4, 2)))
    whole = langid._sums(model, texts)
    for row, t in zip(whole, texts, strict=True):
        ids, counts = langid.subwords(t)
        assert np.allclose(row, (model.table[ids] * counts[:, None]).sum(0)) and row[-1] == counts.sum()
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert np.allclose(langid._sums(model, texts), whole)


def test_scores_mean_what_they_say():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 4000)
    model = langid.Model(["p", "q"], np.zeros((langid.BUCKETS, 2)), np.eye(2))
    right = rng.random(4000) < 0.8  # one subword that speaks for the label four times in five, ten times too loudly
    model.embeddings[0], model.embeddings[1] = (14, 0), (0, 14)
    examples = [(np.array([y if ok else 1 - y]), np.array([1])) for y, ok in zip(labels, right, strict=True)]
    langid.calibrate(model, examples, labels, accuracy=0.9)
    p = model.scores(np.array([model.table[ids].sum(0) for ids, _ in examples])).max(1)
    assert abs(p.mean() - 0.8) < 0.02 and model.accepted == np.inf


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
def test_given_documents(spark):
    docs = spark.read.parquet(SF)
    got = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
