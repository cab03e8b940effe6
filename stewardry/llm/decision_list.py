"""Learned decision lists: ordered threshold rules, grown and pruned by sequential covering (native).

The statistics of a text are DataFrame expressions. ``learn`` covers the rejected labels rule by rule: a rule grows one
threshold at a time by the gain in information, then loses the conditions that do not help on held-back rows, and joins
the list only while it is precise there. ``verdict`` turns the list into one ordered conditional expression.

A null or empty text has no words and all its statistics are 0. Repeated rows each get the same result. An empty table,
or one without labels of both kinds, gives an empty list, which keeps everything. Columns beyond ``doc_id`` and
``text`` are neither read nor needed; ``with_statistics`` overwrites input columns of the same names as its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import SPACES, labelled, let, words_of
from stewardry.scale import cut

WINDOW = 8
#: Ratios are whole numbers, so that thresholds and results do not hang on the order of floating-point sums.
FEATURES = {
    "words": "n_words",
    "mean_length": "n_words = 0 ? 0 : 100 * word_chars div n_words",
    "symbols": "n_words = 0 ? 0 : 1000 * n_symbols div n_words",
    "dup_lines": "n_lines = 0 ? 0 : 1000 * n_dup_lines div n_lines",
    "repeats": "n_words = 0 ? 0 : 1000 * n_repeat_words div n_words",
    "distinct": "n_words = 0 ? 0 : 1000 * n_distinct_words div n_words",
    "stops": "n_words = 0 ? 0 : 1000 * n_stops div n_words",
    "line_words": "n_lines = 0 ? 0 : n_words div n_lines",
}


def _repeats(hashes: Column) -> Column:
    """How many words lie in windows of eight words that the text has twice or more."""
    windows = F.when(
        F.size(hashes) >= WINDOW,
        F.slice(
            F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])),
            F.lit(1),
            F.size(hashes) - (WINDOW - 1),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def positions(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            )

        return F.sort_array(F.transform(let(ordered, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(positions(w), covered)),
    ).cast("bigint")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add the statistics of ``text``: all of the whole text, each a count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_hashes = F.transform(lines, lambda x: F.xxhash64(x))
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    counted = let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(h)).cast("bigint").alias("n_distinct_words"),
            _repeats(h).alias("n_repeat_words"),
        ),
    )
    in_lines = let(
        line_hashes,
        lambda h: F.struct(
            F.size(h).cast("bigint").alias("n_lines"),
            (F.size(h) - F.size(F.array_distinct(h))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    out = docs.select(
        *docs.columns,
        counted.alias("_counted"),
        in_lines.alias("_in_lines"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("_n_symbols"),
        F.regexp_count(text, F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("bigint").alias("_n_stops"),
    )
    made = {
        "n_words": F.col("_counted.n_words"),
        "word_chars": F.col("_word_chars"),
        "n_symbols": F.col("_n_symbols"),
        "n_dup_lines": F.col("_in_lines.n_dup_lines"),
        "n_repeat_words": F.col("_counted.n_repeat_words"),
        "n_distinct_words": F.col("_counted.n_distinct_words"),
        "n_lines": F.col("_in_lines.n_lines"),
        "n_stops": F.col("_n_stops"),
    }
    return out.withColumns(made).drop("_counted", "_in_lines", "_word_chars", "_n_symbols", "_n_stops")


def _feature(name: str) -> Column:
    rule = FEATURES[name]
    if "?" not in rule:
        return F.expr(rule)
    test, _, rest = rule.partition(" ? ")
    zero, _, value = rest.partition(" : ")
    return F.expr(f"CASE WHEN {test} THEN {zero} ELSE {value} END")


def features() -> list[Column]:
    return [_feature(name).cast("bigint").alias(f"f_{name}") for name in FEATURES]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = _feature(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    test = F.lit(True)
    for condition in rule:
        test = test & condition.column()
    return test


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Information that a condition gains about the rejected rows it keeps."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = 20_000, bins: int = 24,
    most_rules: int = 8, most_conditions: int = 3, precision: float = 0.98, support: int = 3,
) -> list[Rule]:
    """Rules that reject what ``label`` marks 0, learned from at most ``most_labelled`` labelled documents.

    Rows that fail the base rules are left out: the list is for what those miss. Two rows in three grow rules, one in three prunes and accepts them. A rule is accepted if at least ``support``
    held-back rows meet it and at least ``precision`` of them are marked 0; learning ends at the first that fails.
    Each step is one aggregation into counts per feature and quantile bin; the driver sees those counts only.
    """
    sample = cut(labelled(docs.select("doc_id", "text"), labels, label, most_labelled), "labelled-texts")
    rows = with_statistics(sample).where(~base_failed())
    rows = cut(  # statistics of at most most_labelled rows, read by each step
        rows.withColumn("_grow", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).drop("text"), "labelled"
    )
    levels = [k / bins for k in range(1, bins)]
    edges_row = rows.agg(*[F.percentile_approx(f, levels, 10_000).alias(f"f_{n}") for n, f in zip(FEATURES, features(), strict=True)]).first()
    edges = {n: sorted(set(edges_row[f"f_{n}"] or [])) for n in FEATURES}
    if not any(edges.values()):
        return []

    def bin_of(name: str) -> Column:
        place = F.lit(0)
        for edge in edges[name]:
            place = place + (_feature(name) >= edge).cast("int")
        return place

    placed = F.array(*[F.struct(F.lit(n).alias("feature"), bin_of(n).alias("bin")) for n in FEATURES if edges[n]])

    def counts(test: Column) -> dict[tuple[str, int], list[int]]:
        found = (
            rows.where(test).select("_label", F.inline(placed)).groupBy("feature", "bin")
            .agg(F.sum((F.col("_label") == 0).cast("int")).alias("bad"), F.count("*").alias("n")).collect()
        )
        return {(r["feature"], r["bin"]): [r["bad"], r["n"] - r["bad"]] for r in found}

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            by_bin = counts(left & F.col("_grow") & _all(rule))
            first = next((n for n in FEATURES if edges[n]), None)
            bad = sum(v[0] for k, v in by_bin.items() if k[0] == first)
            good = sum(v[1] for k, v in by_bin.items() if k[0] == first)
            if not bad or not good:
                break
            best, chosen = 1e-9, None
            for name, cuts in edges.items():
                below_bad = below_good = 0
                for k, edge in enumerate(cuts):
                    b, g = by_bin.get((name, k), (0, 0))
                    below_bad, below_good = below_bad + b, below_good + g
                    for at_least, kept_bad, kept_good in (
                        (False, below_bad, below_good), (True, bad - below_bad, good - below_good),
                    ):
                        gain = _gain(kept_bad, kept_good, bad, good)
                        if gain > best:
                            best, chosen = gain, Condition(name, at_least, edge)
            if chosen is None:
                break
            rule = (*rule, chosen)
        if not rule:
            break
        # the shortest of the rule's beginnings that is as precise on the held-back rows as any
        held = left & ~F.col("_grow")
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        seen = rows.where(held).agg(
            *[F.coalesce(F.sum((_all(h) & (F.col("_label") == 0)).cast("int")), F.lit(0)).alias(f"bad_{k}") for k, h in enumerate(heads)],
            *[F.coalesce(F.sum(_all(h).cast("int")), F.lit(0)).alias(f"n_{k}") for k, h in enumerate(heads)],
        ).first()
        precise = [seen[f"bad_{k}"] / seen[f"n_{k}"] if seen[f"n_{k}"] >= support else 0.0 for k in range(len(heads))]
        best_k = precise.index(max(precise))
        if precise[best_k] < precision:
            break
        rules.append(heads[best_k])
        left = left & ~_all(heads[best_k])
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row with statistics, from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(_all(rule), F.lit(k + 1)) if out is None else out.when(_all(rule), F.lit(k + 1))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with their statistics, ``base_failed``, the number ``rule`` of the rejecting rule, and ``kept``."""
    return (
        with_statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
