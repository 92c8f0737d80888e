"""Fill-in-the-middle texts: documents cut at two units and put in the order prefix-suffix-middle or suffix-prefix-middle.

A unit is what a pattern matches, a line if nothing else is asked for. One fullmatch of the repeated group keeps the end
of every repetition: their number is the number of units, and both cuts are looked up among them. Which units are cut at,
and in which order the parts go, hangs on a seed and the document's id alone, so a rerun of a lost task gives the same
text. Cut texts come apart again without knowing the cuts, as no text that holds a sentinel is cut.

A null text counts as empty; an empty one, one with a sentinel, or one that a given pattern does not cover stays plain. A
null id has no digits in what is hashed. Rows with equal ids and texts are cut alike and all kept; other columns are not
read, so their names cannot clash. A match holds some hundred bytes for each unit of the text it is in, besides the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents

LINES = r"[^\n]*+\n|[^\n]++"


@dataclass(frozen=True)
class Rule:
    """How texts are cut; rate and spm are hundredths: of documents that are cut, and of those that begin with the suffix."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        starts = {s[:1] for s in self.sentinels}
        if "" in starts or len(set(self.sentinels)) < 3 or any(c in s[1:] for c in starts for s in self.sentinels):
            raise ValueError("sentinels must differ, and none may hold a first character of one but in front: parts could not be told apart")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the seed and the id."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(text: str, doc_id: int | None, rule: Rule, units: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle (None: plain) and the new text."""
    whole = units.fullmatch(text)
    ends = whole.ends(1) if whole else []
    n = len(ends)
    first, second, cuts, order = draws(rule.seed, doc_id)
    if not n or any(s in text for s in rule.sentinels) or cuts % 100 >= rule.rate:
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    before, between, after = text[:a], text[a:b], text[b:]
    if order % 100 < rule.spm:
        return n, "spm", a, b - a, f"{rule.suffix}{after}{rule.prefix}{before}{rule.middle}{between}"
    return n, "psm", a, b - a, f"{rule.prefix}{before}{rule.suffix}{after}{rule.middle}{between}"


_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(df: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output, the text as it is trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({rule.unit})*+")
        for part in chunks(batches, "text"):
            ids = part.column("doc_id")
            rows = [cut(text, i, rule, units) for i, text in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, _ROWS.types[1:], strict=True))], schema=_ROWS)

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that output was made of: parts lie between sentinels, which none of them holds."""
    p, s, m = (F.lit(x) for x in rule.sentinels)
    part = lambda text, at, k: F.split_part(text, at, F.lit(k))
    head, tail = part(output, m, 1), part(output, m, 2)
    psm = F.concat(part(part(head, p, 2), s, 1), tail, part(head, s, 2))
    spm = F.concat(part(head, p, 2), tail, part(part(head, s, 2), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digest(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Contract columns: hashes of each output and of the text that is rebuilt from it."""
    rows = fill_in_middle(docs, rule)
    hashed = lambda text: F.sha2(text, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"), rule)).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
