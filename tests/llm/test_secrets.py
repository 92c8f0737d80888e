from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldgate.llm import secrets

LONG = "y" * 40
MORE = [
    (100, f"ghp_{LONG} and xoxb-1234567890ab"), (101, "AIza" + "Z" * 35 + " sk_live_" + "a" * 20), (102, "-----BEGIN RSA PRIVATE KEY-----\nabc"),
    (103, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK postgres://me:secretpw@host"), (104, "TOKEN = \"0123456789abcdef0123456789abcdef\""),
    (105, "api-key: abcdefgh password:short token=secret=abcdefghijk"), (106, "пароль token:абв token:" + "z" * 9),
]


def spans(t: str, rules) -> list[tuple[int, int, int, str]]:
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end(), r.kind) for m in re.finditer(r.pattern, t) if len(m.group(r.group)) >= r.least]
    return sorted(out)


def shown(s) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in s)


@pytest.fixture(scope="module")
def table(spark, docs, rows):
    more = spark.createDataFrame([(i, t, None, "s", None, "r", 1) for i, t in MORE], docs.schema)
    return docs.unionByName(more), rows + MORE


def test_digest(table, empty):
    docs, rows = table
    got = sorted(map(tuple, secrets.secrets_digest(docs).collect()), key=str)
    want = []
    for i, t in rows:
        s = spans(t or "", secrets.RULES)
        n = [sum(x[1] == k for x in s) for k in range(3)]
        want.append((i, *n, hashlib.sha256(shown([x for x in s if x[1] < 3]).encode()).hexdigest(), shown(s)))
    assert got == sorted(want, key=str)
    assert secrets.secrets_digest(empty).count() == 0


def test_masks(table):
    docs, rows = table
    out = secrets.mask_secrets(docs)
    assert out.schema == docs.schema
    for r in out.collect():
        t = next(t for i, t in rows if i == r["doc_id"])
        want, at = "", 0
        for a, _, b, _ in spans(t or "", secrets.RULES):
            if a >= at:
                want += (t or "")[at:a] + secrets.MASK
            at = max(at, b)
        assert r["text"] == (None if t is None else want + t[at:])


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_matches_hold_a_term_of_the_query(rule):
    query = secrets.trigram_query(rule.pattern)
    assert query or rule.kind == "hex"

    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(re.compile(rule.pattern), fullmatch=True))
    def check(text):
        low = text.lower()
        assert not query or any(all(g in low for g in term) for term in query)

    check()


def test_queries():
    assert secrets.trigram_query("abc|de") == []
    assert secrets.trigram_query("abcd?") == [frozenset({"abc"})]
    assert secrets.trigram_query("(foo|bar)[a-z]+") == [frozenset({"bar"}), frozenset({"foo"})]


def test_many_matches_in_one_text(spark):
    """Several blocks of matches, rules that overlap, code points of more than a byte."""
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32 + k % 3)) for k in range(700)]
    text = " ".join(f"\u00e9{k} token={h}" if k % 2 else f"\u4e2d {h}, secret: short" for k, h in enumerate(hexes))
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    want = []
    for rank, rule in enumerate(secrets.RULES):
        want += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
    assert [tuple(x) for x in got] == sorted(want) and len(want) > 1000
    out, at = [], 0
    for start, _, end, _ in sorted(want):
        if start >= at:
            out += [text[at:start], secrets.MASK]
        at = max(at, end)
    clean = secrets.mask_secrets(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {1: "".join([*out, text[at:]]), 2: "nothing", 3: None}
