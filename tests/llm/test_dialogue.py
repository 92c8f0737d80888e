from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

from compare import canonical
from yieldgate.llm import dialogue as d


def every_edit(kinds: list[int], faults: list[int]) -> tuple[int, str]:
    """The best of all edits, with at most two turns put in at a place."""
    best, n = (99, ""), len(kinds)

    def go(i: int, cost: int, audit: str, made: str, run: int) -> None:
        nonlocal best
        if cost > min(best[0], 2 * n):
            return
        if i == n and re.fullmatch("(s?(ua)+)?", made):
            best = min(best, (cost, audit))
        if run < 2:
            for c in "ua":
                go(i, cost + 5, audit + "I", made + c, run + 1)
        if i < n:
            go(i + 1, cost + 2, audit + "D", made, 0)
            if faults[i] not in (d.BLANK, d.DUPLICATE):
                extra = 5 if faults[i] == d.TRUNCATED else 0
                go(i + 1, cost + extra, audit + "K", made + "uasx"[kinds[i]], 0)
                for c in "ua":
                    go(i + 1, cost + extra + 1, audit + "R", made + c, 0)

    go(0, 0, "", "", 0)
    return best


def automaton(kinds: list[int], faults: list[int]) -> tuple[int, str]:
    """Best cost and audit before each state of the grammar: nothing, after s, after u, after a."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    put = lambda best, q, v: best.__setitem__(q, min(v, best.get(q, v)))

    def filled(now: dict) -> dict:
        for _ in range(3):
            for q, (c, a) in list(now.items()):
                put(now, after[q], (c + 5, a + "I"))
        return now

    now = filled({0: (0, "")})
    for k, f in zip(kinds, faults, strict=True):
        then: dict = {}
        for q, (c, a) in now.items():
            put(then, q, (c + 2, a + "D"))
            if f in (d.BLANK, d.DUPLICATE):
                continue
            c += 5 * (f == d.TRUNCATED)
            fits = k == (d.USER if after[q] == 2 else d.ASSISTANT)
            put(then, after[q], (c + (not fits), a + ("K" if fits else "R")))
            if q == 0 and k == d.SYSTEM:
                put(then, 1, (c, a + "K"))
        now = filled(then)
    return min(now[q] for q in (0, 3) if q in now)


@pytest.mark.parametrize("cells", [d.CELLS, 0])
def test_least_audit_of_the_least_cost(cells):
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 4)
        kinds, faults = [rng.choice([0, 1, 0, 1, 2, 3]) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert d.align(np.array(kinds, np.uint8), np.array(faults, np.uint8), cells) == every_edit(kinds, faults) == automaton(kinds, faults)
    for n in [*range(5, 45), 400]:
        for share in (0.1, 0.9):
            kinds = [rng.choice([0, 1, 0, 1, 2, 3]) if rng.random() < share else k % 2 for k in range(n)]
            faults = [rng.choice([0] * 9 + [1, 2, 3]) for _ in range(n)]
            assert d.align(np.array(kinds, np.uint8), np.array(faults, np.uint8), cells) == automaton(kinds, faults)


def test_the_incumbent_is_never_too_small():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(0, 12)
        kinds, faults = [rng.choice([0, 1, 2, 3]) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert automaton(kinds, faults)[0] <= d.incumbent(kinds, faults) <= 2 * n


def rows() -> list[tuple]:
    rng, out = random.Random(5), []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ärger"])
            text = rng.choice(["Yes.", "Yes.", "no end", " \n\t", "", None, "Über?", f"Turn {turn}! ", "a. b. c\x0b", "x" * 500 + "."])
            out.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    out += [(None, k, "user", "Who?") for k in range(5)] + [(None, None, "system", "Be. ")] + [(-7, 3, "user", "Once.")] * 3 + [(1 << 40, -k, "user", "Back.") for k in range(40)]
    out += [(77, k, "assistant" if k % 2 else "user", f"{k}.") for k in range(700)]
    return out


@pytest.fixture(scope="module")
def turns(spark):
    schema = "conv_id long, turn long, role string, text string, audit string, cost string, same int, dropped boolean"
    return spark.createDataFrame([(*r, "x", "y", 1, None) for r in rows()], schema).repartition(5)


def test_digest_is_the_sql_s(turns):
    con = duckdb.connect()
    con.register("conversations", turns.select("conv_id", "turn", "role", "text").toArrow())
    got = d.repair_digest(turns).toPandas()
    assert canonical(got.astype({"conv_id": "Int64"})) == canonical(con.execute(d.SQL).df().astype({"conv_id": "Int64"}))
    assert len(got) == len({r[0] for r in rows()})
    assert d.repair_digest(turns.where("1 = 0")).count() == 0


def test_repaired_turns_follow_the_grammar(spark, turns):
    got: dict = {}
    for r in sorted(d.repair(turns).collect(), key=lambda r: (str(r["conv_id"]), r["turn"])):
        got.setdefault(r["conv_id"], []).append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r["role"][:1] for r in part)) and [r["turn"] for r in part] == list(range(len(part))) for part in got.values())
    assert "".join(r["edit"] for r in got[77]) == "K" * 700 and [r["text"] for r in got[77]] == [f"{k}." for k in range(700)]
    short = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, d.repair(short).collect())) == [(1, 0, "user", "Well?", "K"), (1, 1, "assistant", "Yes.", "K")]


def test_all_turns_dropped(spark):
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = d.repair_digest(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in one] == [(conv, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
