"""Secret scans by a trigram inverted index.

Every rule is a regular expression. `trigram_query` derives from its syntax tree which trigrams any match must hold, as
an OR of ANDs. `build_index` makes postings (trigram, doc_id) for the trigrams that rules ask for; `candidates`
intersects them by counting, and only documents that come through are searched by the rule's expression. Rules without
mandatory trigrams search every document.

Everything is DataFrame functions; the syntax trees of the few rules are read on the driver.

Defined results: spans are code points, end exclusive, leftmost and not overlapping within a rule, matches that are too
short dropped afterwards; a null or empty text has none; candidates go by id, so that repeated or null ids are searched
once for each row; other columns are kept out by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and the least length of a group's text (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base rules, in the order in which kinds are listed; letters of the names in either case.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules that the method adds: tokens with fixed marks of their issuers, key blocks, logins in addresses.
MORE = (
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+!$*-]{4,64}@"),
)
RULES = BASE + MORE
MASK = "[secret]"
#: More alternatives than this end a run of known strings.
_MOST = 16
#: Matches that are folded together; arrays are appended to within these only, so that work grows with the matches.
BLOCK = 128


def _strings(node: list, most: int) -> list[set[str] | None]:
    """The tree as a sequence of sets of strings; None stands for text that is not known."""
    out: list[set[str] | None] = []
    for op, arg in node:
        if op is c.LITERAL:
            out.append({chr(arg).lower()})
        elif op is c.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                span = [value] if kind is c.LITERAL else range(value[0], value[1] + 1) if kind is c.RANGE else None
                if span is None or len(span) + len(chars) > most:
                    chars = None
                    break
                chars |= {chr(x).lower() for x in span}
            out.append(chars)
        elif op is c.SUBPATTERN:
            out.extend(_strings(arg[3], most))
        elif op is c.BRANCH:
            every: set[str] | None = set()
            for way in arg[1]:
                parts = _strings(way, most)
                if any(p is None for p in parts):
                    every = None
                    break
                every |= reduce(lambda a, b: {x + y for x in a for y in b}, parts, {""})
            out.append(every)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, body = arg
            parts = _strings(body, most)
            if low == 0 and high == 1 and len(parts) == 1 and parts[0]:
                out.append(parts[0] | {""})
            elif low == high and low <= 4:
                out.extend(parts * low)
            else:
                out.extend(parts * min(low, 1) + [None] if low else [None])
        elif op is not c.AT:
            out.append(None)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match holds; empty: none are mandatory.

    Runs of known strings are multiplied out; of several runs the one with the longest mandatory strings is asked for.
    """
    runs: list[set[str]] = [{""}]
    for strings in _strings(list(parser.parse(pattern)), _MOST):
        joined = strings and {a + b for a in runs[-1] for b in strings}
        if joined and len(joined) <= 2 * _MOST:
            runs[-1] = joined
        else:
            runs.append(set(strings) if strings else {""})
            if strings:
                runs.append({""})
    runs = [r for r in runs if min(map(len, r)) >= 3]
    if not runs:
        return []
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in max(runs, key=lambda r: (min(map(len, r)), -len(r)))}
    return sorted((g for g in grams if not any(h < g for h in grams)), key=sorted)


def build_index(docs: DataFrame, grams: Iterable[str]) -> DataFrame:
    """Postings (gram, doc_id) of the trigrams asked for, over the lower-case text."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(grams))))
    return low.select(F.explode(found).alias("gram"), "doc_id")


def candidates(postings: DataFrame, asked: dict[int, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the rules (indices) one of whose terms has all its trigrams among the document's postings."""
    spark = postings.sparkSession
    terms = [(k, t, g, len(grams)) for k, query in asked.items() for t, grams in enumerate(query) for g in sorted(grams)]
    terms = spark.createDataFrame(terms, "rule int, term int, gram string, n_grams int")  # of the rules' size
    hits = postings.join(F.broadcast(terms), "gram").groupBy("doc_id", "rule", "term", "n_grams").agg(F.count_distinct("gram").alias("n"))
    return hits.where("n = n_grams").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """BLOCK neighbours of an array at a time."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What all values ahead of each add up to, from 0."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, begin, step, lambda acc: acc["out"])


def _spans(text: Column, rule: Rule, index: int) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches: what stands between and in them gives the places."""
    pattern = F.lit(rule.pattern)
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern).alias("gap"), whole.alias("match"), tested.alias("tested"))
    both = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(index).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        good = F.coalesce(F.length(x["tested"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def fold(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("found")), step, lambda acc: acc["found"])

    def folded(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + both(x)))
        return F.flatten(F.zip_with(blocks, _before(sizes, lambda a, b: a + b), fold))

    found = _let(parts, lambda p: _let(_blocks(p), folded))
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of docs' columns), text (null: empty) and spans (array of start, rank, end, kind; sorted)."""
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    if asked:
        postings = written(build_index(df, {g for q in asked.values() for grams in q for g in grams}), "postings")
        found = candidates(postings, asked).withColumnRenamed("doc_id", "candidate")
        df = df.join(found, df["doc_id"].eqNullSafe(found["candidate"]), "left").drop("candidate")
    else:
        df = df.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    each = []
    for k, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, k)
        each.append(F.when(F.coalesce(F.array_contains("rules", k), F.lit(False)), spans).otherwise(none) if k in asked else spans)
    return df.select("row", "text", F.array_sort(F.concat(*each)).alias("spans"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every run of overlapping spans replaced by MASK; rows without spans are as they were."""
    text, spans = F.col("text"), F.col("spans")
    last = lambda block: F.array_max(F.transform(block, lambda x: x["end"]))

    def fold(block: Column, begin: Column) -> Column:
        """What a block of spans leaves of its own part of the text, which begins where those ahead of it end."""

        def of(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                ahead = F.concat(F.substring(part, acc["at"] - begin + 1, x["start"] - acc["at"]), F.lit(MASK))
                more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(ahead))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

            return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

        return _let(F.substring(text, begin + 1, F.greatest(last(block) - begin, F.lit(0))), of)

    def folded(blocks: Column) -> Column:
        return F.array_join(F.zip_with(blocks, _before(F.transform(blocks, last), F.greatest), fold), "")

    clean = F.concat(_let(_blocks(spans), folded), F.substring(text, last(spans) + 1, F.length(text)))
    found = find_secrets(docs, rules, id_col, text_col).select("row", F.when(F.size(spans) > 0, clean).otherwise(F.col(f"row.{text_col}")).alias("clean"))
    return found.select(*(F.col("clean").alias(n) if n == text_col else F.col(f"row.`{n}`").alias(n) for n in docs.columns))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Contract columns for every document."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    spans = F.col("spans")
    of = lambda k: F.size(F.filter(spans, lambda x: x["rank"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(shown(F.filter(spans, lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"), shown(spans).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {p}) AS gaps, "
            f"regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {r.group}) AS tested FROM d WHERE regexp_matches(t, {p})"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, rank, kind, i, least, tested[i] AS tested, length(whole[i]) AS n,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
spans AS (SELECT doc_id, rank, CAST(start AS BIGINT) AS start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT)) AS s FROM placed WHERE length(tested) >= least),
docs AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN docs USING (doc_id)
"""


SQL = _sql()

assert re.compile(RULES[0].pattern).groups == 2
