"""Secret scans through a trigram inverted index (native).

Each rule is a regular expression. From its syntax tree comes a Boolean query of trigrams that any match must contain;
the postings of those trigrams are intersected into candidate texts, and only these are searched with the expression.
A rule without a mandatory trigram searches every text. Trigrams are lower-cased, so that a query never misses a match.

A null text is an empty one and has no spans. Rows equal in id and text share a key and get equal results. An empty
table gives an empty result. Of the input only ``doc_id`` and ``text`` are read; other columns do not matter.
Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import let, row_keys
from stewardry.scale import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds; the rest are public formats of well-known credentials.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 0, 24),
)
BASE = ("assign", "access", "hex")
#: Sets of strings larger than this are given up for a weaker query.
SLICE = 256  # matches of a text that are walked at once
MOST_STRINGS = 64

#: A query in disjunctive form: one of the sets of trigrams must be contained whole. None: any text may match.
Query = frozenset[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= MOST_STRINGS else a


def _least(sets: frozenset[frozenset[str]]) -> Query:
    """Without sets that contain another one."""
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _trigrams(strings: set[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The strings a part of the expression stands for, if they are few, and else a query it implies."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN and arg[0][0] is not sre.NEGATE and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 5:
        return {chr(a).lower() for _, a in arg}, None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), None
        queries = [_trigrams(s) if s is not None else q for s, q in found]
        return None, None if any(q is None for q in queries) else _least(frozenset().union(*queries))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        strings, implied = _sequence(sub)
        if high == 1 and strings is not None:
            return strings | ({""} if low == 0 else set()), None
        if low == high and strings is not None and len(strings) == 1:
            return {next(iter(strings)) * low}, None
        return None, None if low == 0 else _trigrams(strings) if strings is not None else implied
    if op is sre.AT:
        return {""}, None
    return None, None


def _sequence(items) -> tuple[set[str] | None, Query]:
    open_strings, implied, whole = {""}, None, True
    for op, arg in items:
        strings, query = _node(op, arg)
        if strings is not None and len(strings) * len(open_strings) <= MOST_STRINGS:
            open_strings = {a + b for a in open_strings for b in strings}
        else:
            whole = False
            implied = _both(implied, _trigrams(open_strings))
            implied = _both(implied, query if strings is None else _trigrams(strings))
            open_strings = {""}
    return (open_strings, None) if whole else (None, _both(implied, _trigrams(open_strings)))


def trigram_query(pattern: str) -> Query:
    """The sets of trigrams of which a lower-cased text must contain one whole if the expression matches in it."""
    strings, implied = _sequence(_parser.parse(pattern))
    return _trigrams(strings) if strings is not None else implied


def index(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """Postings: a row (trigram, key of the text) for each of ``trigrams`` a text contains. Written once, then read."""
    wanted = "(?=(" + "|".join(re.escape(t) for t in sorted(trigrams)) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(wanted), F.lit(1)))
    return cut(docs.select(*row_keys("doc_id", "text"), F.explode(found).alias("trigram")), "postings")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect postings: per text, the kinds whose query it satisfies. A text has at most as many rows as trigrams."""

    def meets(query: Query) -> Column:
        test = F.lit(False)
        for needed in sorted(map(sorted, query)):
            test = test | (F.size(F.array_intersect("_found", F.array(*map(F.lit, needed)))) == len(needed))
        return test

    kinds = F.array_compact(F.array(*[F.when(meets(q), F.lit(kind)) for kind, q in queries.items()]))
    return (
        postings.groupBy("_k1", "_k2").agg(F.collect_set("trigram").alias("_found"))
        .select("_k1", "_k2", kinds.alias("_kinds")).where(F.size("_kinds") > 0)
    )


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All leftmost non-overlapping matches that pass, as structs of start, order, end and kind.

    Spark has no function for the positions of all matches: they are the running lengths of the texts between matches
    and of the matches. These are added up over slices, then inside each, so that the work grows with the matches.
    """
    pattern = F.lit(rule.pattern)
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matched
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(matched, lambda x: F.length(x)).alias("width"),
        F.transform(tested, lambda x: F.length(x)).alias("tested"),
    )
    span = "struct<start:bigint,order:int,end:bigint,kind:string>"

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["width"]
        made = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(span))
        keep = part["tested"] >= rule.least  # null in the last part, which no match follows
        return F.struct(
            F.coalesce(end, start).cast("bigint").alias("at"),
            F.when(keep, F.concat(state["spans"], made)).otherwise(state["spans"]).alias("spans"),
        )

    def inside(slice_: Column, begin: Column) -> Column:
        return F.aggregate(slice_, F.struct(begin.alias("at"), F.array().cast(f"array<{span}>").alias("spans")), step)["spans"]

    def begins(slices: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all"))
        size = lambda s: F.aggregate(s, zero, lambda n, part: n + part["gap"] + F.coalesce(part["width"], F.lit(0)))
        return F.aggregate(slices, first, lambda state, s: F.struct(
            (state["at"] + size(s)).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all")
        ))["all"]

    def walked(all_parts: Column) -> Column:
        last = F.floor((F.size(all_parts) - 1) / SLICE).cast("int")
        slices = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_parts, k * SLICE + 1, F.lit(SLICE)))
        return let(slices, lambda s: let(begins(s), lambda at: F.flatten(F.transform(s, lambda part, k: inside(part, F.get(at, k))))))

    return F.when(text.rlike(_least_pattern(rule)), let(parts, walked)).otherwise(F.array().cast(f"array<{span}>"))


def _least_pattern(rule: Rule) -> str:
    """A cheap test that any passing match meets: a pattern of one repeated class must reach its least length."""
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        return f"{rule.pattern[:-1]}{{{max(1, rule.least)},}}"
    return rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``text`` and ``found``: the spans of all rules in each text, by start, then in the rules' order."""
    docs = docs.select("doc_id", "text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    keyed = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    if indexed:
        postings = index(docs, {t for q in indexed.values() for need in q for t in need})
        keyed = keyed.join(candidates(postings, indexed), ["_k1", "_k2"], "left")
    else:
        keyed = keyed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        if rule.kind in indexed:
            spans = F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none)
        found.append(spans)
    return keyed.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"))


def joined(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined, of all or of some kinds."""
    chosen = found if kinds is None else F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return let(F.filter(found, lambda x: x["kind"] == kind), F.size).cast("bigint")
