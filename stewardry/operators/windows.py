"""Ordered work: first wins, ranges, incidents, transitions, allocation, log context, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.scale import CHUNK, block_of, dealt, first_per_key, ranked, running_total, tasks_for, with_previous


def first_wins(
    rows: DataFrame, keys: Sequence[str], input_rank: str = "input_rank", line: str = "line"
) -> tuple[DataFrame, DataFrame]:
    """Surviving rows (first by input order, then line) and the duplicates that lost to them."""
    keys = list(keys)
    survivors = first_per_key(rows, keys, [input_rank, line], count_as="n_seen")
    marks = survivors.where(F.col("n_seen") > 1).select(
        *keys, F.col(input_rank).alias("kept_input"), F.col(line).alias("kept_line")
    )
    losers = rows.join(marks, keys).where(
        (F.col(input_rank) != F.col("kept_input")) | (F.col(line) != F.col("kept_line"))
    )
    return survivors, losers


RANGE_BLOCK = 4096


def collapse_ranges(
    rows: DataFrame, parent: str, name: str, siblings: Sequence[str], *, min_rows: int = 4
) -> DataFrame:
    """Fold ``eth0 .. eth47`` into ``eth[0-47]`` per parent where all sibling columns are equal.

    Runs shorter than ``min_rows`` stay single names. Zero-padded numbers form ranges of their own
    width. Of a number of more than 18 digits the last 18 are folded, behind the digits before them
    (``sn123[000000000000000007-000000000000000019]``), which expands to the same names.
    Equal rows are folded first; see :func:`duplicate_names` for reporting them.

    Islands are found inside blocks of the number line, so a parent of any size is spread over
    tasks; only the pieces that touch a block border are then stitched. The rows are counted first and
    dealt out by block to as many tasks as they are worth, before anything is held of them.
    """
    siblings = list(siblings)
    digits, before = (F.regexp_extract(name, r"^(.*?)(\d+)\z", k) for k in (2, 1))
    split = (
        rows.select(parent, name, *siblings)
        .withColumn("_all", digits)
        .withColumn("_digits", F.right("_all", F.lit(18)))
        .withColumn("_prefix", F.concat(before, F.left("_all", F.length("_all") - 18)))
        .withColumn("_num", F.col("_digits").try_cast("bigint"))
        .withColumn(
            "_width",
            F.when((F.length("_all") > 18) | F.col("_digits").rlike("^0."), F.length("_digits")).otherwise(F.lit(0)),
        )
    )
    numbered = split.where(F.col("_num").isNotNull() & F.col(parent).isNotNull())
    # siblings are grouping columns themselves: NULL equals NULL there, and all aggregates stay numeric
    group = [parent, "_prefix", "_width", *siblings]
    blocks = numbered.select(*group, "_num", block_of(F.col("_num"), RANGE_BLOCK).alias("_block"))
    distinct = dealt(blocks, [*group, "_block"], tasks_for(rows)).distinct()
    within = Window.partitionBy(*group, "_block").orderBy("_num")
    pieces = (
        distinct.withColumn("_island", F.col("_num") - F.row_number().over(within))
        .groupBy(*group, "_block", "_island")
        .agg(F.min("_num").alias("_lo"), F.max("_num").alias("_hi"))
        .drop("_block", "_island")
    )
    touches = (F.pmod("_lo", F.lit(RANGE_BLOCK)) == 0) | (
        F.pmod("_hi", F.lit(RANGE_BLOCK)) == RANGE_BLOCK - 1
    )
    order = Window.partitionBy(*group).orderBy("_lo")
    border = pieces.where(touches).withColumn(
        "_new", (F.col("_lo") != F.coalesce(F.lag("_hi").over(order) + 1, F.lit(-1))).cast("int")
    )
    stitched = (
        border.withColumn("_run", F.sum("_new").over(order))
        .groupBy(*group, "_run")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .drop("_run")
    )
    runs = pieces.where(~touches).unionByName(stitched).withColumn(
        "n_rows", F.col("_hi") - F.col("_lo") + 1
    )

    def shown(number: Column) -> Column:
        text = number.cast("string")
        padded = F.lpad(text, F.greatest(F.col("_width"), F.length(text)), F.lit("0"))
        return F.when(F.col("_width") > 0, padded).otherwise(text)

    def entry(label: Column, rows: Column, ranged: bool) -> Column:
        return F.struct(label.alias("label"), rows.cast("bigint").alias("n"), F.lit(ranged).alias("ranged"))

    folded = F.concat("_prefix", F.lit("["), shown(F.col("_lo")), F.lit("-"), shown(F.col("_hi")), F.lit("]"))
    singles = F.transform(
        F.sequence("_lo", "_hi"), lambda i: entry(F.concat("_prefix", shown(i)), F.lit(1), False)
    )
    entries = F.when(
        F.col("n_rows") >= min_rows, F.array(entry(folded, F.col("n_rows"), True))
    ).otherwise(singles)
    listed = runs.select(parent, *siblings, F.explode(entries).alias("_e")).select(
        parent, F.col("_e.label").alias(name), *siblings, F.col("_e.n").alias("n_rows"),
        F.col("_e.ranged").alias("expand_range"),
    )
    plain = split.where(F.col("_num").isNull() | F.col(parent).isNull()).select(
        parent, name, *siblings
    ).distinct().withColumn("n_rows", F.lit(1).cast("bigint")).withColumn("expand_range", F.lit(False))
    return listed.unionByName(plain)


def duplicate_names(rows: DataFrame, parent: str, name: str) -> DataFrame:
    """Names that occur more than once under one parent."""
    return rows.groupBy(parent, name).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def time_chunk(ts: str, seconds: int) -> Column:
    return block_of(F.unix_seconds(F.col(ts).cast("timestamp")), seconds)


def incidents(
    signals: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, *, tie: Sequence[str] = (),
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Number the clusters of each timeline: a new one starts after more than ``gap_seconds``.

    One timeline may hold most of the log: work is cut by the hour and stitched over the borders.
    """
    order = [ts, *tie]
    rows = signals.withColumn(CHUNK, time_chunk(ts, chunk_seconds))
    near = with_previous(rows, keys, order, None, [ts], "_before")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    quiet = micros(F.col(ts)) - micros(F.col("_before")[ts])
    opens = F.when(F.col("_before").isNull() | (quiet > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = running_total(near, keys, order, None, opens, "incident")
    return numbered.drop("_before", CHUNK)


# How far upstream a service sits; the lowest tier present holds the root.
SERVICE_TIERS = {
    "database": 0,
    "message-queue": 0,
    "cache": 0,
    "server": 1,
    "task-manager": 2,
    "task-worker": 3,
}


def tier_of(service: str, tiers: dict[str, int]) -> Column:
    """The tier of a service; unknown services sit below all known ones."""
    out = F.lit(max(tiers.values()) + 1)
    for name, tier in tiers.items():
        out = F.when(F.col(service) == name, F.lit(tier)).otherwise(out)
    return out


def root_candidate(
    clustered: DataFrame, incident: Sequence[str], service: str, order: Sequence[str],
    tiers: dict[str, int] = SERVICE_TIERS,
) -> DataFrame:
    """Per incident the earliest failure of the most upstream tier present, and the cascade size.

    The loudest signal never wins. A partial aggregate: an incident of any size is one row per task.
    """
    rows = clustered.withColumn("tier", tier_of(service, tiers))
    picked = first_per_key(rows, incident, ["tier", *order], count_as="n_signals")
    return picked.withColumn("n_cascade", F.col("n_signals") - 1)


def red_to_green(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, *, failed: Column, passed: Column,
    chunk_seconds: int = 86400,
) -> DataFrame:
    """Passes directly preceded by a failure of the same keys."""
    rows = (
        events.withColumn("_state", F.when(failed, "red").when(passed, "green"))
        .withColumn(CHUNK, time_chunk(ts, chunk_seconds))
    )
    seen = with_previous(rows, keys, [ts, tie], None, ["_state", ts], "_before")
    turned = seen.where((F.col("_state") == "green") & (F.col("_before._state") == "red"))
    return turned.withColumn("red_ts", F.col("_before")[ts]).drop("_before", "_state", CHUNK)


def ever_red_to_green(
    events: DataFrame, keys: Sequence[str], ts: str, *, failed: Column, passed: Column
) -> DataFrame:
    """Keys that fail once and pass at any later time (a single partial aggregate)."""
    folded = events.groupBy(*keys).agg(
        F.min(F.when(failed, F.col(ts))).alias("first_red"),
        F.max(F.when(passed, F.col(ts))).alias("last_green"),
    )
    return folded.where(F.col("first_red") < F.col("last_green"))


def allocate_next(
    requests: DataFrame,
    pools: DataFrame,
    used: DataFrame,
    *,
    requester: str,
    pool: str = "pool",
    block: int = 100_000,
) -> DataFrame:
    """Give each requester the next free number of its pool.

    ``pools`` has ``pool, low, high``, more than once for a pool of several ranges that do not overlap; ``used`` has
    ``pool, number`` and the requester that holds it (NULL = held by something else); requesters are numbers. Who
    already holds a number keeps it; a pool that runs out yields ``exhausted`` rows. Free numbers are never listed:
    the gaps between used ones are intervals, their lengths add up to ranks, and a request takes the number of its own
    rank. Gaps behind the last request are left out. Ranks and sums run over blocks of numbers.
    """
    held = used.where(F.col(requester).isNotNull()).groupBy(pool, requester).agg(
        F.min("number").alias("number")
    )
    asked = requests.select(pool, requester).distinct()
    kept = asked.join(held, [pool, requester])
    waiting = asked.join(held, [pool, requester], "left_anti")
    ranges = pools.select(pool, F.col("low").cast("bigint").alias("_low"), F.col("high").cast("bigint").alias("_high"))
    taken = (
        used.select(pool, F.col("number").cast("bigint").alias("number")).distinct().join(ranges, pool)
        .where(F.col("number").between(F.col("_low"), F.col("_high")))
    )
    seen = with_previous(taken, [pool, "_low"], ["number"], block_of(F.col("number"), block), ["number"], "_before")
    after = F.coalesce(F.col("_before.number") + 1, F.col("_low"))
    inner = seen.select(pool, after.alias("_first"), (F.col("number") - after).alias("_n"))
    last = ranges.join(taken.groupBy(pool, "_low").agg(F.max("number").alias("_top")), [pool, "_low"], "left")
    after = F.coalesce(F.col("_top") + 1, F.col("_low"))
    outer = last.select(pool, after.alias("_first"), (F.col("_high") - after + 1).alias("_n"))
    gaps = inner.unionByName(outer).where(F.col("_n") > 0)
    gaps = running_total(gaps, [pool], ["_first"], block_of(F.col("_first"), block), F.col("_n"), "_to")
    wait_rank = ranked(waiting, [pool], [requester], block_of(F.col(requester), block), "_rank")
    wanted = waiting.groupBy(pool).agg(F.count("*").alias("_wanted"))
    # a gap meets the requests of its ranks in stretches of 1024
    begin = F.col("_to") - F.col("_n") + 1
    useful = gaps.join(wanted, pool).where(begin <= F.col("_wanted")).select(
        pool, "_first", begin.alias("_begin"), F.least("_to", "_wanted").alias("_end"),
    )
    listed = useful.withColumn("_part", F.explode(F.sequence(F.shiftright("_begin", 10), F.shiftright("_end", 10))))
    granted = (
        wait_rank.withColumn("_part", F.shiftright("_rank", 10)).alias("w")
        .join(listed.alias("g"), [pool, "_part"])
        .where(F.col("_rank").between(F.col("_begin"), F.col("_end")))
        .select(pool, requester, (F.col("_first") + F.col("_rank") - F.col("_begin")).alias("number"))
    )
    granted = waiting.join(granted, [pool, requester], "left")
    status = F.when(F.col("number").isNull(), "exhausted").otherwise("allocated")
    return kept.withColumn("status", F.lit("kept")).unionByName(granted.withColumn("status", status))


def log_tail(lines: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key. Each task keeps ``n`` per key before anything is shuffled."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return lines.withColumn("from_end", F.row_number().over(latest)).where(F.col("from_end") <= n)


CLASS_LINE = r"^[A-Za-z_][\w.]*(:|\s*$)"


def stitch_tracebacks(lines: DataFrame, *, own_code: str, block: int = 100_000) -> DataFrame:
    """One row per traceback of ``file, line_no, text``: class, message and innermost own frame.

    Every line that is not indented opens a segment (a running count over blocks of lines). A
    traceback is a segment headed by its opening line, which may stand behind a log prefix; the head of
    the next segment is its exception line if it is a class alone or with a message.
    """
    flush = F.when(F.col("text").rlike(r"^\s|^\z"), 0).otherwise(1)
    parts = running_total(
        lines, ["file"], ["line_no"], block_of(F.col("line_no"), block), flush, "_seg"
    )
    frame = F.col("text").rlike(r'^\s+File "') & F.col("text").contains(own_code)
    segments = parts.groupBy("file", "_seg").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("text", "line_no").alias("head"),
        F.max_by("text", F.when(frame, F.col("line_no"))).alias("frame"),
    )
    opened = segments.where(F.col("head").contains("Traceback (most recent call last)"))
    closing = segments.select(
        "file", (F.col("_seg") - 1).alias("_seg"), F.when(F.col("head").rlike(CLASS_LINE), F.col("head")).alias("exception")
    )
    return opened.join(closing, ["file", "_seg"], "left").select(
        "file",
        "line_no",
        F.regexp_extract("exception", r"^([\w.]+)", 1).alias("exception_class"),
        F.regexp_extract("exception", r"^[\w.]+:\s*(.*)", 1).alias("message"),
        F.trim("frame").alias("innermost_frame"),
    )


def context(
    lines: DataFrame, hits: DataFrame, keys: Sequence[str], position: str, *, before: int = 2, after: int = 6
) -> DataFrame:
    """The lines around each hit. Only hits fan out; the join on a dense position has no hot key."""
    keys = list(keys)
    spread = hits.select(
        *keys,
        F.col(position).alias("hit"),
        F.explode(F.sequence(F.col(position) - before, F.col(position) + after)).alias(position),
    )
    return spread.join(lines, [*keys, position])


def sort_breaks(
    rows: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], *, block: int = 100_000
) -> DataFrame:
    """Rows that come before their predecessor in the declared order (none = sorted)."""
    seen = with_previous(
        rows, keys, [position], block_of(F.col(position), block), list(order), "_before"
    )
    return seen.where(F.col("_before") > F.struct(*order)).drop("_before")


LETTERS = 6  # 26**6 siblings, 300 million


def load_order(levels: DataFrame, *, kind: str = "kind", level: str = "level") -> DataFrame:
    """``NN`` from the dependency level and sibling letters (``a`` .. ``z``, ``aa`` .. ``zz``, ``aaa`` ..).

    The number is as wide as the highest level needs, two digits at least. The input has one row per
    kind of a schema, so a level is a handful of rows.
    """
    w = Window.partitionBy(level).orderBy(kind)
    placed = levels.where(F.col(level).isNotNull()).withColumn("_n", F.row_number().over(w).cast("bigint"))
    letters, left = F.lit(""), F.col("_n")
    for _ in range(LETTERS):
        letters = F.concat(F.when(left > 0, F.chr(F.lit(97) + F.pmod(left - 1, F.lit(26)))).otherwise(F.lit("")), letters)
        left = F.floor((left - 1) / 26)
    number = (F.col(level) + 1).cast("string")
    width = F.greatest(F.lit(2), F.length(F.max(F.col(level) + 1).over(Window.partitionBy(F.lit(0))).cast("string")))
    return placed.select(kind, level, F.concat(F.repeat(F.lit("0"), width - F.length(number)), number, letters).alias("prefix"))


def order_findings(
    findings: DataFrame, *, phase: str, sorted_phase: str, position: str = "position"
) -> DataFrame:
    """Findings with their report position: the ladder phase by (step, file), others as they came."""
    ladder = F.col(phase) == sorted_phase
    rows = findings.withColumn("_step", F.when(ladder, F.col("ladder_step")).otherwise(F.lit(0)))
    file = F.when(ladder, F.coalesce(F.col("file"), F.lit(""))).otherwise(F.lit(""))
    part = F.when(ladder, F.lit(0)).otherwise(block_of(F.col(position), 100_000))
    chunk = F.struct(F.col("_step").alias("step"), file.alias("file"), part.alias("part"))
    order = ["_step", file, position]
    return ranked(rows, [phase], order, chunk, "report_position").drop("_step")


def truncate_report(found: DataFrame, key: str, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows per policy with its total and how many more there are.

    Totals are counted apart, so the listing keeps ``n`` rows per key in each task before shuffling.
    """
    totals = found.groupBy(key).agg(F.count("*").alias("total"))
    first = Window.partitionBy(key).orderBy(*order)
    shown = found.withColumn("shown", F.row_number().over(first)).where(F.col("shown") <= n)
    return shown.join(totals, key).withColumn(
        "more", F.greatest(F.col("total") - n, F.lit(0)).cast("bigint")
    )


def top_matches(
    subjects: DataFrame, scored: DataFrame, subject: str, match: str, score: str, k: int = 3
) -> DataFrame:
    """The best ``k`` matches per subject, or one row with rank 0 and no match."""
    best = Window.partitionBy(subject).orderBy(F.col(score).desc(), F.col(match))
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return (
        subjects.select(subject)
        .join(top.select(subject, match, score, "rank"), subject, "left")
        .withColumn("rank", F.coalesce("rank", F.lit(0)).cast("bigint"))
    )
