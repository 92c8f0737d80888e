"""Repair of conversations: turns are aligned to the alternating grammar (s?(ua)+)? at the least cost.

A turn is kept (K, 0), gets the role that the grammar wants (R, 1) or goes (D, 2); a turn without text can be put in
(I, 5). Blank turns and repeats must go, and a truncated turn that stays costs 5 more. Targets are the grammar's strings
of every length: a Wagner-Fischer table has the cost of aligning the turns from i on to a target's last r places, which
are the same for targets of all lengths, so one table serves them all. Its cells are held to Ukkonen's band: those that
the cost of a plain left-to-right repair, the incumbent, leaves possible. Of every length that comes out cheapest the
audit is traced, and the least of these is taken. A table of more than CELLS cells is folded: costs then hang on whether
r is even, which gives the same audit, as both alternate.

Spark cuts the work at conversations and sorts their turns in two streams. The first sees a byte a turn and traces the
audit; in the second the audit comes before its turns, whose texts pass one by one. So a conversation of any length needs
memory for its bytes and one audit, never for its texts. Roles go by their first letter; an empty role has none.

Null roles and texts count as one space, a null id is a conversation of its own. Turns are ordered by number (nulls
first), ties by role and then by a hash of role and text; repeated rows are all kept until the repair finds them. Other
columns are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: White space, as in [\x20\x09-\x0D].
WHITE = "\t\n\x0b\x0c\r "
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = ("user", "assistant")
#: What a role begins with, as numbers; user and assistant are the parities of places before a target's end.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
#: Cells of a table that is kept as it is (4 bytes each).
CELLS = 1 << 23
FAR = 1 << 29


def incumbent(kinds: list[int], faults: list[int]) -> int:
    """The cost of a repair from left to right: faulty turns go, others are kept, renamed, or go if the next one fits."""
    good = [k for k, f in zip(kinds, faults, strict=True) if f == FINE]
    cost, want, pairs, system, last = DELETE * (len(kinds) - len(good)), USER, 0, False, 0
    for at, k in enumerate(good):
        if k == SYSTEM and not system and not pairs and want == USER:
            system = True
            continue
        if k != want and at + 1 < len(good) and good[at + 1] == want:
            cost += DELETE
            continue
        last = int(k != want) * RENAME
        cost += last
        pairs += want == ASSISTANT
        want = 1 - want
    if want == ASSISTANT:
        cost += DELETE - last
    if system and not pairs:
        cost += DELETE
    return min(cost, DELETE * len(kinds))


class Table:
    """Costs of aligning turns i, i+1, ... to the last r places of a target, within the band of a cost."""

    def __init__(self, kinds: np.ndarray, faults: np.ndarray, most: int, cells: int = CELLS):
        self.kinds, self.n = kinds, len(kinds)
        self.must_go = (faults == BLANK) | (faults == DUPLICATE)
        self.extra = np.where(faults == TRUNCATED, CUT_OFF, 0)
        #: Turns from i on that may stay.
        self.left = np.r_[np.cumsum((~self.must_go)[::-1])[::-1], 0].astype(np.int64)
        slack = max(0, most - DELETE * int(self.must_go.sum()))
        self.below, width = slack // DELETE, slack // DELETE + slack // INSERT + 1
        self.folded = (self.n + 1) * width > cells
        if self.folded:
            self._fold()
        else:
            self._fill(width)

    def _fill(self, width: int) -> None:
        self.cost = np.full((self.n + 1, width), FAR, np.int32)
        places = np.arange(width, dtype=np.int64)
        steps = INSERT * places
        r = self.left[self.n] - self.below + places
        self.cost[self.n] = np.where(r >= 0, INSERT * r, FAR)
        for i in range(self.n - 1, -1, -1):
            r, after = self.left[i] - self.below + places, self.cost[i + 1]
            if self.must_go[i]:
                best = after + DELETE
            else:
                best = np.r_[after[1:], FAR] + DELETE
                stay = after + self.extra[i] + np.where((r & 1) == self.kinds[i], 0, RENAME)
                best = np.where(r >= 1, np.minimum(best, stay), best)
            best = np.where(r >= 0, best, FAR)
            self.cost[i] = np.minimum(np.minimum.accumulate(best - steps) + steps, FAR)

    def _fold(self) -> None:
        """Costs by parity of r, whatever r is; the third is that of an even r that is not 0."""
        even, odd, some = 0, INSERT, 2 * INSERT
        rows = [(even, odd, some)]
        for k, must, extra in zip(self.kinds[::-1].tolist(), self.must_go[::-1].tolist(), self.extra[::-1].tolist(), strict=True):
            u, a = (FAR, FAR) if must else (extra + RENAME * (k != USER), extra + RENAME * (k != ASSISTANT))
            e, o, s = min(even + DELETE, u + odd), min(odd + DELETE, a + even), min(some + DELETE, u + odd)
            even, odd, some = min(e, INSERT + o), min(o, INSERT + e), min(s, INSERT + o)
            rows.append((even, odd, some))
        self.cost = np.array(rows[::-1], np.int64)

    def at(self, i: int, r: int) -> int:
        """r: places left; in a folded table 0, 1 or 2: even, odd, even but not 0."""
        if self.folded:
            return int(self.cost[i, r])
        k = r - int(self.left[i]) + self.below
        return int(self.cost[i, k]) if r >= 0 and 0 <= k < self.cost.shape[1] else FAR

    def lengths(self, i: int) -> np.ndarray:
        """Even numbers of places that turns from i on can be aligned to within the band."""
        if self.folded:
            return np.array([0, 2])
        r = self.left[i] - self.below + np.arange(self.cost.shape[1])
        return r[(r >= 0) & (r % 2 == 0)]

    def trace(self, i: int, r: int) -> str:
        """The cheapest edits of turns from i on for r places; of equal ones the least."""
        out = []
        while i < self.n or (r == 1 if self.folded else r > 0):
            here, fewer = self.at(i, r), (1 - r % 2 if self.folded else r - 1)
            if i < self.n and here == DELETE + self.at(i + 1, r):
                out.append("D")
                i += 1
            elif (r > 0 or self.folded) and here == INSERT + self.at(i, fewer):
                out.append("I")
                r = fewer
            else:
                out.append("K" if r % 2 == self.kinds[i] else "R")
                i, r = i + 1, fewer
        return "".join(out)


def align(kinds: np.ndarray, faults: np.ndarray, cells: int = CELLS) -> tuple[int, str]:
    """The least cost and the ASCII-least audit that has it, over targets of every feasible length."""
    n = len(kinds)
    if not n:
        return 0, ""
    table = Table(kinds, faults, incumbent(kinds.tolist(), faults.tolist()), cells)
    found = [(table.at(0, r), 0, r, "") for r in table.lengths(0).tolist() if not (table.folded and r)]
    best = min((c for c, *_ in found), default=FAR)
    for i in np.flatnonzero((kinds == SYSTEM) & ~table.must_go).tolist():
        if DELETE * i > best:
            break
        before = DELETE * i + int(table.extra[i])
        found += [(before + table.at(i + 1, r), i + 1, r, "D" * i + "K") for r in table.lengths(i + 1).tolist() if r]
        best = min(best, min((c for c, at, *_ in found if at == i + 1), default=best))
    return best, min(head + table.trace(i, r) for cost, i, r, head in found if cost == best)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped, as the contract's rule damages them; dropped ones stay, so that no id is lost."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.withColumn("_h", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20)
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_h") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


#: Nulls come first, as Spark sorts.
ORDER = ("turn", "role", "same")


def marked(rows: DataFrame) -> DataFrame:
    """rows with `same`, equal for equal role and text; both without a text of its own length being kept apart."""
    return rows.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn and code (4 * kind + fault; -1: dropped) of each turn, conversations together and in order."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    kind: Column = F.when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "s", SYSTEM).otherwise(OTHER)
    light = rows.select("conv_id", "turn", "role", "same", "dropped", kind.alias("kind"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    light = light.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "same").orderBy("turn")) > 1
    light = light.withColumn("again", again)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    code = F.when(F.col("dropped"), -1).otherwise(4 * F.col("kind") + fault)
    return light.withColumn("code", code.cast("byte")).sortWithinPartitions("conv_id", *ORDER, "again").select("conv_id", "turn", "code")


_FACTS = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
FACTS = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c, _ in _FACTS)


class _Turns:
    """What is kept of a conversation while its turns pass: a byte each, and the numbers seen."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.low, self.last, self.distinct = conv_id, bytearray(), None, None, 0

    def add(self, turns: np.ndarray, known: np.ndarray, codes: np.ndarray) -> None:
        there = codes >= 0
        self.codes += codes[there].astype(np.uint8).tobytes()
        turns = turns[there & known]
        if len(turns):
            if self.low is None:
                self.low = int(turns[0])
            self.distinct += int(np.count_nonzero(np.diff(turns))) + (self.last != int(turns[0]))
            self.last = int(turns[-1])

    def facts(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        kinds, faults = codes >> 2, codes & 3
        pairs = 4 * kinds[:-1] + kinds[1:]
        legal = np.isin(pairs, [4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER])
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.distinct
        cost, audit = align(kinds, faults)
        return self.conv_id, gaps, *(int(np.count_nonzero(faults == f)) for f in (BLANK, DUPLICATE, TRUNCATED)), int(np.count_nonzero(~legal)), cost, audit


def _runs(ids: pa.Array) -> Iterator[tuple[int, int, int | None]]:
    """Start, end and value of runs of equal ids, nulls equal too."""
    there, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero((np.diff(value) != 0) | (there[1:] != there[:-1])) + 1).tolist(), len(ids)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b, int(value[a]) if there[a] else None


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[c for c, _ in schema])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Turns | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done, turn = [], batch.column("turn")
        known, turns, codes = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy(zero_copy_only=False), batch.column("code").to_numpy()
        for a, b, conv_id in _runs(batch.column("conv_id")):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.facts())
                now = _Turns(conv_id)
            now.add(turns[a:b], known[a:b], codes[a:b])
        if done:
            yield _table(done, _FACTS)
    if now is not None:
        yield _table([now.facts()], _FACTS)


def audits(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, illegal neighbours, the repair's cost and its audit. rows: those of marked()."""
    return _codes(rows).mapInArrow(_judge, FACTS)


class Script:
    """A conversation's turns as its audit wants them; turns come in order, one by one."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.system = (len(audit) - audit.count("D")) % 2
        self.made = 0

    def _role(self) -> str:
        return ROLES[(self.made - self.system) % 2]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._role(), "", "I"
            self.at, self.made = self.at + 1, self.made + 1

    def feed(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """role, text and edit of what stands in for this turn and of turns put in before it."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield (role if edit == "K" else self._role()), text, edit
            self.made += 1

    def close(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _scripts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Turns in order behind a row with their conversation's facts."""
    none = [F.lit(None).cast("long").alias(c) for c, t in _FACTS[1:-1]]
    turns = rows.where("not dropped").select("conv_id", F.lit(1).alias("mark"), "turn", "role", "same", "text", *none)
    heads = facts.select("conv_id", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("same"), F.col("audit").alias("text"), *(c for c, _ in _FACTS[1:-1]))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "mark", *ORDER).drop("turn", "same")


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]], bool]]:
    """A conversation's facts, what comes of the turns that are there, and whether these are its last."""
    facts, script = (), None
    for batch in batches:
        names = [c for c, _ in _FACTS[1:-1]]
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = zip(*(part.column(c).to_pylist() for c in ("conv_id", "mark", "role", "text", *names)), strict=True)
            for conv_id, mark, role, text, *rest in rows:
                if mark:
                    yield facts, script.feed(role, text), False
                else:
                    if script is not None:
                        yield facts, script.close(), True
                    facts, script = (conv_id, *rest, text), Script(text)
    if script is not None:
        yield facts, script.close(), True


_DIGEST = [*_FACTS, ("repaired_sha256", pa.string())]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, hasher, any_yet = [], hashlib.sha256(), False
    for facts, turns, last in _played(batches):
        for role, text, _ in turns:
            hasher.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
            any_yet = True
        if last:
            done.append((*facts, hasher.hexdigest()))
            hasher, any_yet = hashlib.sha256(), False
            if len(done) >= 1024:
                yield _table(done, _DIGEST)
                done = []
    if done:
        yield _table(done, _DIGEST)


_REPAIRED = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, size, n = [], 0, 0
    for facts, turns, last in _played(batches):
        for role, text, edit in turns:
            done.append((facts[0], n, role, text, edit))
            size, n = size + len(text), n + 1
        n = 0 if last else n
        if len(done) >= 1024 or size >= 1 << 20:
            yield _table(done, _REPAIRED)
            done, size = [], 0
    if done:
        yield _table(done, _REPAIRED)


def plain(turns: DataFrame) -> DataFrame:
    """Turns as they are, in the form that the repair takes."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(False).alias("dropped"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn (anew from 0), role, text and edit (K, R or I) of every turn of the repaired conversations."""
    rows = marked(plain(turns))
    return _scripts(rows, audits(rows)).mapInArrow(_repaired, "conv_id long, turn long, role string, text string, edit string")


def repair_digest(turns: DataFrame) -> DataFrame:
    """Contract columns: conversations are damaged first, then told about and repaired."""
    rows = marked(damaged(turns))
    return _scripts(rows, audits(rows)).mapInArrow(_hashed, f"{FACTS}, repaired_sha256 string")


def _sql() -> str:
    """The same by dynamic programming over what stands before a turn: nothing, a system turn, a user's or an assistant's."""
    plus = lambda q, cost, edit: f"{{'c': {q}.c + {cost}, 't': {q}.t || {edit}}}"
    least = lambda *qs: f"list_min([{', '.join(qs)}])"
    stay = lambda q, role: f"{{'c': {q}.c + e + CAST(k <> '{role}' AS INTEGER), 't': {q}.t || CASE WHEN k = '{role}' THEN 'K' ELSE 'R' END}}"
    none = "{'c': 1000000000, 't': ''}"
    white = "|| ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS crc FROM range(256) t(i)),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                         lambda x, y: xor(x // 256, crc[xor(x, y) % 256 + 1])), 4294967295) % 20 AS h FROM conversations, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, (SELECT unnest([0, 1]) AS copy) WHERE h > 0 AND (copy = 0 OR h = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, rtrim(text, {white}) AS body, substr(role, 1, 1) AS k FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), again) AS i FROM r),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lead(k) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM o),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (after IS NOT NULL AND k || after NOT IN ('su', 'ua', 'au')) AS illegal, list({{'k': k, 'f': fault}} ORDER BY i) AS turns FROM f GROUP BY conv_id),
st AS (
  SELECT conv_id, turns, 0 AS i, '' AS k, '' AS f, 0 AS e, {{'c': 0, 't': ''}} AS n, {none} AS s, {{'c': 5, 't': 'I'}} AS u, {{'c': 10, 't': 'II'}} AS a FROM g
  UNION ALL
  SELECT conv_id, turns, i, k, f, e, n, s, u2 AS u, {least("a", plus("u2", 5, "'I'"))} AS a FROM (
    SELECT *, {least("u", plus("n", 5, "'I'"), plus("s", 5, "'I'"), plus("a", 5, "'I'"))} AS u2 FROM (
      SELECT conv_id, turns, i, k, f, e, {plus("n", 2, "'D'")} AS n, CASE WHEN f IN ('b', 'd') OR k <> 's' THEN {plus("s", 2, "'D'")} ELSE {least(plus("s", 2, "'D'"), plus("n", "e", "'K'"))} END AS s,
             CASE WHEN f IN ('b', 'd') THEN {plus("u", 2, "'D'")} ELSE {least(plus("u", 2, "'D'"), stay("n", "u"), stay("s", "u"), stay("a", "u"))} END AS u,
             CASE WHEN f IN ('b', 'd') THEN {plus("a", 2, "'D'")} ELSE {least(plus("a", 2, "'D'"), stay("u", "a"))} END AS a
      FROM (SELECT conv_id, turns, i + 1 AS i, turns[i + 1].k AS k, turns[i + 1].f AS f, CASE WHEN turns[i + 1].f = 't' THEN 5 ELSE 0 END AS e, n, s, u, a FROM st WHERE i < len(turns))))),
best AS (SELECT conv_id, {least("n", "a")} AS b FROM st WHERE i = len(turns)),
letters AS (SELECT conv_id, b.t AS audit, unnest(range(1, CAST(length(b.t) + 1 AS BIGINT))) AS p FROM best),
places AS (
  SELECT conv_id, p, substr(audit, p, 1) AS x, length(replace(substr(audit, 1, p), 'I', '')) AS i,
         length(replace(substr(audit, 1, p), 'D', '')) - 1 - length(replace(audit, 'D', '')) % 2 AS place FROM letters),
made AS (
  SELECT l.conv_id, string_agg(CASE x WHEN 'K' THEN f.role ELSE CASE place % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END
                               || ':' || CASE x WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS made
  FROM places l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE x <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()
