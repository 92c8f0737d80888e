"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column that is true where it rejects a text. `plan_cascade` runs every rule alone over a random
sample of bounded expected size, notes its cost (seconds above those of no rule, the median of three runs) and
selectivity (share rejected), and orders the rules by rejection per cost;
`cascade` joins them by AND NOT in that order, so that a text rejected early never meets the dearer rules. The order
decides the cost only, never the verdict.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Defined results: a null or empty text has no words and fails the
base rule; rules see the text alone, so other columns, ties and repeated rows make no difference.

Everything is DataFrame functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
#: Rows, on average, of the sample on which cost and selectivity are estimated; the verdict does not depend on it.
SAMPLE_ROWS, RUNS = 2000, 3

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return let(trimmed(text), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"[\x20\x09-\x0D]+")))


def full_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(full_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(w: Column) -> Column:
    """Words inside windows of 8 words that the text holds twice or more.

    Hashes of the windows tell whether any can repeat; only then are the windows themselves sorted, with their places,
    so that equal ones stand side by side and the places of repeated ones give the words covered.
    """
    places = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))
    some = F.when(F.size(w) < WINDOW + 1, F.lit(False)).otherwise(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)))
    return F.when(some, let(windows, _covered)).otherwise(F.lit(0)).cast("long")


def _covered(windows: Column) -> Column:
    def neighbours(x: Column, i: Column) -> Column:
        same = lambda k: F.coalesce(F.get(windows, k)["w"] == x["w"], F.lit(False))
        return F.when(same(i - 1) | same(i + 1), x["i"])

    def words_in(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    return let(F.array_sort(F.filter(F.transform(windows, neighbours), lambda x: x.isNotNull())), words_in)


@dataclass(frozen=True)
class Rule:
    """A name and what makes, from a text's features, a column that is true where the rule rejects."""

    name: str
    rejects: Callable[[SimpleNamespace], Column]


def default_rules() -> list[Rule]:
    """The base rules and heuristics of web-text filters, with wide margins."""
    return [
        Rule("few_words", lambda x: x.n_words < MIN_WORDS),
        Rule("repeats", lambda x: F.lit(100) * x.n_repeat_words > F.lit(REPEAT_PERCENT) * x.n_words),
        Rule("word_length", lambda x: ~((x.word_chars * 10).between(x.n_words * 15, x.n_words * 200))),
        Rule("symbols", lambda x: x.n_symbols * 5 > x.word_chars),
        Rule("dup_lines", lambda x: x.n_dup_lines * 2 > x.n_lines),
        Rule("letters", lambda x: F.regexp_count(x.text, F.lit(r"\p{L}")) * 2 < x.word_chars),
        Rule("replacement", lambda x: F.regexp_count(x.text, F.lit("\ufffd")) * 20 > x.word_chars),
    ]


def features(text: Column, w: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(full_lines(text)).cast("long"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(w),
    }


def plan_cascade(df: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """The rules with cost and selectivity as measured on a sample of `rows` rows from all over df, best first.

    A rule's cost is what it takes by itself, the features it needs included, over the sample held in memory.
    """
    share = min(1.0, rows / max(1, df.count()))
    sample = df.select(F.col(text_col).alias("text")).sample(share, seed=1).repartition(1).cache()

    def timed(kept: Column) -> tuple[float, int]:
        took, k = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            k = sample.where(kept).count()
            took.append(time.perf_counter() - began)
        return median(took), k

    try:
        n = max(1, sample.count())
        nothing, _ = timed(F.col("text").isNotNull())
        found = []
        for rule in rules:
            took, k = timed(~cascade([rule], F.col("text")))
            found.append((rule, max(1e-4, took - nothing), k / n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def passed(rules: list[Rule], x: SimpleNamespace) -> Column:
    """True where no rule rejects; AND leaves out what stands behind the first rule that does."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & ~F.coalesce(rule.rejects(x), F.lit(False))
    return kept


def cascade(rules: list[Rule], text: Column) -> Column:
    """The verdict from the text alone: features are computed when the first rule that asks for them is reached."""
    text = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: passed(rules, SimpleNamespace(text=text, words=w, **features(text, w))))


def keep_quality(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the cascade keeps, as they are."""
    order = [x[0] for x in plan_cascade(docs, rules or default_rules(), sample_rows, text_col)]
    return docs.where(cascade(order, F.col(text_col)))


def quality_digest(docs: DataFrame) -> DataFrame:
    """Contract columns for every document: its features are wanted anyway, so the cascade reads them as columns."""
    order = [x[0] for x in plan_cascade(docs, default_rules())]
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", words(F.col("text")))
    df = df.withColumns(features(F.col("text"), F.col("words")))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * n)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = passed(order, SimpleNamespace(text=F.col("text"), **{k: F.col(k) for k in names}))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


FEATURES_SQL = r"""
docs AS (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {source}),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
feats AS (
  SELECT docs.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters,
         length(t) - length(replace(t, chr(65533), '')) AS n_broken
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars * 10 < n_words * 15
              OR word_chars * 10 > n_words * 200 OR n_symbols * 5 > word_chars OR n_dup_lines * 2 > n_lines
              OR n_letters * 2 < word_chars OR n_broken * 20 > word_chars) AS kept
  FROM feats)"""

SQL = f"""
WITH {FEATURES_SQL.format(source="documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines,
       n_repeat_words, base_failed, kept
FROM judged
"""
