"""Counts, uniqueness, scores, profiles and log statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.functions.coerce import BLANKS


def related_count(
    objects: DataFrame,
    related: DataFrame,
    key: str,
    related_key: str,
    *,
    condition: Column | None = None,
    minimum: int = 0,
    maximum: int = 0,
) -> DataFrame:
    """Objects whose number of related rows, zero included, is out of bounds (maximum 0 = none).

    Related rows are counted per key before the join, so the join sees one row per object.
    """
    met = F.lit(True) if condition is None else condition
    counts = related.groupBy(F.col(related_key).alias(key)).agg(F.count_if(met).alias("_n"))
    counted = objects.join(counts, key, "left").withColumn("n_related", F.coalesce("_n", F.lit(0)))
    bad = F.col("n_related") < minimum
    if maximum:
        bad = bad | (F.col("n_related") > maximum)
    return counted.where(bad).drop("_n")


def required_categories(
    objects: DataFrame, related: DataFrame, key: str, related_key: str, category: str,
    required: Sequence[str],
) -> DataFrame:
    """Objects missing at least one required category; the missing ones are listed."""
    counts = related.groupBy(F.col(related_key).alias(key)).agg(
        *[F.count_if(F.col(category) == c).alias(f"_c{i}") for i, c in enumerate(required)]
    )
    missing = F.array_compact(
        F.array(
            *[F.when(F.coalesce(f"_c{i}", F.lit(0)) == 0, F.lit(c)) for i, c in enumerate(required)]
        )
    )
    joined = objects.join(counts, key, "left").withColumn("missing", F.array_join(missing, ","))
    return joined.where(F.col("missing") != "").drop(*[f"_c{i}" for i in range(len(required))])


def group_violations(found: DataFrame, key: str) -> DataFrame:
    """Violations with their group (``unknown`` when absent) and the size of that group.

    The listing stays rows: the count is a partial aggregate joined back, so no group is ever
    gathered into one array or task.
    """
    rows = found.withColumn("group", F.coalesce(F.col(key), F.lit("unknown")))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n_in_group"))
    return rows.join(sizes, "group")


def scorecard(checked: DataFrame, failed: DataFrame) -> DataFrame:
    """Per policy ``checked, passed, failed, pct, status``, and one ``OVERALL`` row.

    ``checked`` has ``policy, checked``; ``failed`` has ``policy, failed``. A policy with an empty
    population fails: nothing was proven.
    """
    per_policy = checked.join(failed, "policy", "left").select(
        "policy", "checked", F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed")
    )
    total = per_policy.rollup("policy").agg(
        F.sum("checked").alias("checked"), F.sum("failed").alias("failed")
    )
    passed = F.col("checked") - F.col("failed")
    status = (
        F.when(F.col("checked") == 0, "FAIL").when(F.col("failed") == 0, "PASS").otherwise("WARN")
    )
    return total.select(
        F.coalesce("policy", F.lit("OVERALL")).alias("policy"),
        "checked",
        passed.alias("passed"),
        "failed",
        F.when(F.col("checked") > 0, F.bround(passed * 100.0 / F.col("checked"), 1)).alias("pct"),
        status.alias("status"),
    )


def policy_counts(policy: str, population: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two one-row inputs a scorecard needs for one policy."""
    return (
        population.agg(F.count("*").alias("checked")).select(F.lit(policy).alias("policy"), "checked"),
        found.agg(F.count("*").alias("failed")).select(F.lit(policy).alias("policy"), "failed"),
    )


def profile_columns(
    df: DataFrame, columns: Sequence[str], *, approximate: bool = False, sample: int = 5
) -> DataFrame:
    """One row per text column over all rows: distinct values, lengths, shapes and a choice hint.

    Values are counted per (column, value) first, so repeated values cross the network once and a
    hot value is no hot task.
    """
    cells = df.unpivot([], list(columns), "column", "value")
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    text = F.trim("value")
    blank = F.col("value").isNull() | F.upper(text).isin(list(BLANKS))
    real = ~blank
    numeric = text.rlike(r"^[+-]?\d+(\.\d+)?\z")
    dated = text.rlike(r"^(\d{4}-\d{2}-\d{2}([T ].*)?|\d{1,2}/\d{1,2}/\d{4})\z")
    numbered = text.rlike(r"^.*\D\d+\z")

    def share(test: Column) -> Column:
        hits = F.sum(F.when(real & test, F.col("n")).otherwise(0))
        total = F.sum(F.when(real, F.col("n")).otherwise(0))
        return F.when(total > 0, F.bround(hits / total, 4))

    kept = F.when(real, F.col("value"))
    distinct = F.approx_count_distinct(kept) if approximate else F.count(kept)
    stats = values.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        distinct.alias("n_distinct"),
        F.min(F.length(kept)).cast("bigint").alias("min_length"),
        F.max(F.length(kept)).cast("bigint").alias("max_length"),
        share(numeric).alias("numeric_share"),
        share(dated).alias("date_share"),
        share(numbered).alias("sequence_share"),
        F.bround(F.sum(F.when(blank, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("blank_share"),
    )
    first = Window.partitionBy("column").orderBy("value")
    shown = (
        values.where(real)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= sample)
        .groupBy("column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("first_values"))
    )
    return stats.join(shown, "column", "left").withColumn(
        "choice_hint", F.col("n_distinct") <= 10
    )


def group_constancy(df: DataFrame, key: str, columns: Sequence[str], *, min_keys: int = 3) -> DataFrame:
    """Which columns are constant within every value of ``key`` (candidates for the parent kind).

    Constant means least equals greatest with NULLs all or none: a partial aggregate, no distinct.
    """
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[
            (
                F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(F.lit(0), F.count("*"))
            ).alias(c)
            for c in columns
        ]
    )
    verdict = per_key.agg(F.count("*").alias("n_keys"), *[F.bool_and(c).alias(c) for c in columns])
    rows = verdict.unpivot(["n_keys"], list(columns), "column", "constant")
    return rows.withColumn("is_parent_column", F.col("constant") & (F.col("n_keys") >= min_keys))


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def merge_conflicts(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every row of a key whose inputs disagree outside the key; equal duplicates merge quietly.

    Agreement is least = greatest over the compared columns as one struct, so conflicting keys come
    from a partial aggregate and both sides are listed as rows by a semi-join.
    """
    keys = list(keys)
    whole = F.struct(*columns)
    clashing = rows.groupBy(*keys).agg(F.min(whole).alias("_lo"), F.max(whole).alias("_hi"))
    clashing = clashing.where(F.col("_lo") != F.col("_hi")).select(*keys)
    return rows.join(clashing, keys, "left_semi")


def capacity(
    containers: DataFrame, members: DataFrame, *, key: str, member_key: str, size: str,
    threshold: float = 0.8,
) -> DataFrame:
    """Containers used above ``threshold`` of their size."""
    used = members.groupBy(F.col(member_key).alias(key)).agg(F.count("*").alias("used"))
    filled = containers.join(used, key).withColumn("usage", F.bround(F.col("used") / F.col(size), 4))
    return filled.where(F.col("used") > F.col(size) * F.lit(threshold))


def score(results: DataFrame, subject: str, *, failures_shown: int | None = None) -> DataFrame:
    """Share of passed checks per subject with the failed names in check order and a band.

    ``results`` has the subject, ``check_order``, ``check`` and ``passed``; NULL ``passed`` is a
    failure. All names are listed, at most one per check; ``failures_shown`` limits a report to the first.
    """
    ok = F.coalesce(F.col("passed"), F.lit(False))
    totals = results.groupBy(subject).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("n_passed")
    )
    failed = results.where(~ok).withColumn("_r", F.col("check_order"))
    if failures_shown is not None:
        order = Window.partitionBy(subject).orderBy("check_order", "check")
        failed = failed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= failures_shown)
    names = (
        failed.groupBy(subject)
        .agg(F.sort_array(F.collect_list(F.struct("_r", "check"))).alias("_f"))
        .select(subject, F.array_join(F.transform("_f", lambda x: x["check"]), ",").alias("failed_checks"))
    )
    value = F.when(F.col("total") == 0, 0.0).otherwise(F.bround(F.col("n_passed") / F.col("total"), 4))
    band = F.when(F.col("score") >= 1.0, "ok").when(F.col("score") >= 0.5, "warn").otherwise("fail")
    return (
        totals.join(names, subject, "left")
        .withColumn("score", value)
        .withColumn("failed_checks", F.coalesce("failed_checks", F.lit("")))
        .withColumn("band", band)
    )


def run_stats(runs: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Mean and sample deviation, which is 0 for a single run."""
    return runs.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.coalesce(F.bround(F.avg(value), digits), F.lit(0.0)).alias("mean"),
        F.coalesce(F.bround(F.stddev_samp(value), digits), F.lit(0.0)).alias("stddev"),
    )


def gate(
    runs: DataFrame, keys: Sequence[str], rate: str, *, run_floor: float = 0.5, suite_floor: float = 0.8
) -> DataFrame:
    """A suite passes when no run is below its floor and the mean reaches the suite floor."""
    folded = runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.bool_or(F.col(rate) < run_floor).alias("any_run_failed"),
        F.bround(F.avg(rate), 3).alias("mean_rate"),
    )
    passed = ~F.col("any_run_failed") & (F.col("mean_rate") >= suite_floor)
    return folded.withColumn("passed", passed)


def with_vs_baseline(
    expected: DataFrame, runs: DataFrame, keys: Sequence[str], *, variant: str, rate: str,
    treated: str = "with", baseline: str = "without",
) -> DataFrame:
    """Mean rate with and without treatment and the difference; missing output scores 0."""
    means = runs.groupBy(*keys).pivot(variant, [treated, baseline]).agg(F.avg(rate))
    joined = expected.select(*keys).distinct().join(means, list(keys), "left")
    a = F.bround(F.coalesce(F.col(treated), F.lit(0.0)), 3)
    b = F.bround(F.coalesce(F.col(baseline), F.lit(0.0)), 3)
    return joined.select(
        *keys, a.alias("with_rate"), b.alias("without_rate"), F.bround(a - b, 3).alias("delta")
    )


# Signal classes of a log sweep (case-insensitive unless the text is exact).
SIGNAL_CLASSES: Mapping[str, str] = {
    "traceback": r"Traceback \(most recent call last\)",
    "severity": r"(?i)\b(error|critical|fatal|panic)\b",
    "resource_kill": r"(?i)outofmemory|oomkilled|out of memory|killed",
    "connection": r"(?i)connection (refused|reset|closed)|timed? ?out|retry",
}


def signal_sweep(
    lines: DataFrame,
    services: DataFrame,
    *,
    service: str,
    message: str,
    restarted: Column | None = None,
    classes: Mapping[str, str] = SIGNAL_CLASSES,
) -> DataFrame:
    """Hits per service and class; services without hits stay listed with zero.

    All classes are tested in one pass and counted in one aggregate; a line may hit several.
    """
    tests = {name: F.col(message).rlike(pattern) for name, pattern in classes.items()}
    tests["restart"] = F.lit(False) if restarted is None else restarted
    names = list(tests)
    counts = lines.groupBy(service).agg(*[F.count_if(test).alias(n) for n, test in tests.items()])
    listed = services.select(service).distinct().join(counts, service, "left")
    return (
        listed.unpivot([service], names, "class", "_n")
        .select(service, "class", F.coalesce("_n", F.lit(0)).cast("bigint").alias("hits"))
    )


def collapse_repeats(signals: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """One row per group of like lines with its count, first and last time."""
    return signals.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )


def kind_coverage(expected: DataFrame, found: DataFrame, *, kind: str, file: str) -> DataFrame:
    """Expected kinds no output holds, and kinds spread over more than one output."""
    have = found.groupBy(kind).agg(F.min(file).alias("_lo"), F.max(file).alias("_hi"))
    absent = expected.select(kind).distinct().join(have, kind, "left_anti")
    split = have.where(F.col("_lo") != F.col("_hi"))
    return absent.select(kind, F.lit("missing").alias("problem")).unionByName(
        split.select(kind, F.lit("several_outputs").alias("problem"))
    )


def slow_queries(
    lines: DataFrame, message: str, *, limit_ms: int, pattern: str = r"query (\S+) took (\d+) ms"
) -> DataFrame:
    """Per query name the runs, the runs above the limit, the mean, the worst time and a percentile."""
    timed = lines.select(
        F.regexp_extract(message, pattern, 1).alias("query"),
        F.regexp_extract(message, pattern, 2).try_cast("bigint").alias("ms"),
    ).where(F.col("ms").isNotNull())
    return timed.groupBy("query").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ms") > limit_ms).alias("n_slow"),
        F.sum("ms").alias("total_ms"),
        F.max("ms").alias("max_ms"),
        F.percentile_approx("ms", 0.95, 10000).alias("p95_ms"),
    )


# From how many on a counter of a session is worth a look.
COUNTER_THRESHOLDS = {
    "repeated_errors": 2,
    "edits_of_one": 3,
    "restated": 1,
    "fetches_after_read": 1,
    "reads_before_edit": 4,
}


def session_counters(
    events: DataFrame, keys: Sequence[str], *, ts: str, error: Column, edit: Column, read: Column, ask: Column, fetch: Column,
    tool: str, target: str, request: str,
) -> DataFrame:
    """Five counters of a session, and ``hints``, the names of those that reach their threshold. Hints are no proof.

    The most errors of one tool on one target, the most edits of one target, asks that repeat an earlier one (but for case
    and white space), fetches after the first read, and reads before the first edit. An event is counted in the groups it
    belongs to by one aggregate; the first read and edit are one row per session.
    """
    keys = list(keys)
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    facets = F.array_compact(F.array(
        F.when(error, facet("error", F.concat_ws("\u0001", text(tool), text(target)))),
        F.when(edit, facet("edit", text(target))),
        F.when(ask, facet("ask", F.trim(F.lower(F.regexp_replace(text(request), r"\s+", " "))))),
    ))
    groups = events.select(*keys, F.explode(facets).alias("_f")).groupBy(*keys, "_f.facet", "_f.value").agg(F.count("*").alias("_n"))
    most = lambda name: F.max(F.when(F.col("facet") == name, F.col("_n")))
    counted = groups.groupBy(*keys).agg(
        most("error").alias("repeated_errors"), most("edit").alias("edits_of_one"),
        F.sum(F.when(F.col("facet") == "ask", F.col("_n") - 1)).alias("restated"),
    )
    firsts = events.groupBy(*keys).agg(F.min(F.when(edit, F.col(ts))).alias("_edit"), F.min(F.when(read, F.col(ts))).alias("_read"))
    placed = events.join(firsts, keys)
    early = read & (F.col("_edit").isNull() | (F.col(ts) < F.col("_edit")))
    rows = placed.groupBy(*keys).agg(
        F.count_if(fetch & (F.col(ts) > F.col("_read"))).alias("fetches_after_read"), F.count_if(early).alias("reads_before_edit")
    ).join(counted, keys, "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    rows = rows.select(*keys, *[zero(name).alias(name) for name in COUNTER_THRESHOLDS])
    reached = [F.when(F.col(name) >= least, F.lit(name)) for name, least in COUNTER_THRESHOLDS.items()]
    return rows.withColumn("hints", F.array_compact(F.array(*reached)))


def fixed_profile(profiles: DataFrame, kind: str, attribute: str, value: str, profile: str) -> DataFrame:
    """Attributes that the only profile of a kind sets, always to the same value."""
    only = profiles.groupBy(kind).agg(F.min(profile).alias("profile"), F.max(profile).alias("_other"))
    only = only.where(F.col("profile") == F.col("_other")).drop("_other")
    folded = profiles.where(F.col(value).isNotNull()).groupBy(kind, attribute).agg(
        F.min(value).alias("value"), F.max(value).alias("_rival")
    )
    return folded.where(F.col("value") == F.col("_rival")).drop("_rival").join(only, kind)
