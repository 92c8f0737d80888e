from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
import regex

from compare import canonical
from yieldgate.llm import fim


def plainly(doc_id: int | None, text: str) -> tuple:
    """The contract, unit by unit."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(hexed[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 50 else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if h4 % 100 < 50 else "psm", len(pre), len(mid), out


@pytest.fixture(scope="module")
def awkward(spark, rows):
    more = [(100, "a<P>b"), (101, "<S"), (102, "<\nS>\n"), (103, "\n\n\n"), (104, "one\r\ntwo\x85three"), (105, "\n" * 5000 + "end"), (106, "x<M>"), (107, "P><S\n<\n"), (-3, "minus\none\n"), (108, "𝄞é\n漢字\n")]
    return spark.createDataFrame([(i, t, "n", "f", None) for i, t in [*rows, *more]], "doc_id long, text string, n string, form string, output string").repartition(3)


def test_digest(awkward):
    texts = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((*p[:5], sha(p[5]), sha(t)) for i, t in texts for p in [plainly(i, t)]), key=str)
    assert sorted(map(tuple, fim.fim_digest(awkward).collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fim_digest(awkward.where("1 = 0")).count() == 0


def test_sql(awkward):
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text").toArrow())
    numbers = dict.fromkeys(("doc_id", "prefix_chars", "middle_chars"), "Int64")
    assert canonical(fim.fim_digest(awkward).toPandas().astype(numbers)) == canonical(con.execute(fim.SQL).df().astype(numbers))


def test_other_units_and_shares(awkward):
    rule = fim.Rule(seed=3, rate=40, spm=0, unit=r"\s*+\S++\s*+|\s++", prefix="[pre]", suffix="(suf)", middle="{mid}")
    got = fim.fill_in_middle(awkward, rule).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"), rule)).collect()
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=str)
    forms = [r["form"] for r in got]
    assert "spm" not in forms and 0 < forms.count("psm") < len(forms) - forms.count("psm")
    with pytest.raises(ValueError):
        fim.Rule(prefix="<<")


def test_every_repetition_is_kept():
    text = "line of words\n" * 100_000 + "rest"
    assert fim.cut(text, 5, fim.Rule(), regex.compile(f"({fim.LINES})*+"))[0] == 100_001
