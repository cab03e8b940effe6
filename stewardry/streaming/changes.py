"""Change-triggered checks and the online forms of sweep, incidents and first-wins.

All sinks are files below the shared folder: a restarted query resumes from its checkpoint, and a
batch that runs twice replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stewardry.operators.windows import incidents
from stewardry.scale import new_path


def change_feed(spark, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """New files of a folder as a stream of changed rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Process everything there is, append it to files exactly once, and read the files back."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def targeted_checks(
    changes: DataFrame,
    objects: DataFrame,
    members: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    *,
    change_key: str,
    key: str,
    out: str,
    state: str,
    on_all: bool = False,
) -> None:
    """Run a check once per batch of changes, writing its rows below ``out/batch=N``.

    A targeted check sees the changed objects that belong to its group, a global one (``on_all``)
    the whole kind.
    """

    def each(batch: DataFrame, number: int) -> None:
        keys = batch.select(F.col(change_key).alias(key)).distinct()
        if on_all:
            subjects = objects
        else:
            target = keys.join(members.select(key).distinct(), key, "left_semi")
            subjects = objects.join(target, key, "left_semi")
        check(subjects).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        changes.writeStream.foreachBatch(each)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


@dataclass(frozen=True)
class Outcome:
    """What a stateful stream has come to: closed rows, what is still open, and rows that came too late, as they were."""

    final: DataFrame
    held: DataFrame
    late: DataFrame


def fold_batches(stream: DataFrame, ts: str, delay: str, root: str, fold: Callable[..., tuple[DataFrame, DataFrame, DataFrame]]) -> Outcome:
    """Run a stream to its end with state of its own, in tables below ``root``; a second run goes on where it stood.

    ``fold(rows, held, before, now)`` gets a batch, what the last one held (None in the first), and the watermark
    before and after the batch: the latest ``ts`` less ``delay``, NULL before any row. It gives final, held and late
    rows. All its tables go by the number of the batch: one that runs again reads the state before it and writes
    the same once more. State is as large as what is open, and late rows are rows, not a count.
    """
    spark = stream.sparkSession
    kinds: dict[str, T.StructType] = {}

    def at(what: str, number: int) -> str:
        return f"{root}/{what}/batch={number}"

    def each(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(at("rows", number))
        rows = own.read.schema(batch.schema).parquet(at("rows", number))
        last = own.read.parquet(at("mark", number - 1)).first()["mark"] if number else None
        # one number a batch: the watermark
        before = F.lit(last).cast("bigint")
        marks = rows.agg(F.greatest(F.max(F.unix_micros(ts)) - F.lit(_micros(own, delay)), before).alias("mark"))
        marks.write.mode("overwrite").parquet(at("mark", number))
        now = F.lit(own.read.parquet(at("mark", number)).first()["mark"]).cast("bigint")
        held = own.read.parquet(at("held", number - 1)) if number else None
        for what, made in zip(("final", "held", "late"), fold(rows, held, before, now), strict=True):
            made.write.mode("overwrite").parquet(at(what, number))

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = [r["batch"] for r in spark.read.parquet(f"{root}/mark").select("batch").distinct().collect()]
    for what in ("final", "held", "late"):
        kinds[what] = spark.read.parquet(at(what, max(numbers))).schema
    whole = {what: spark.read.schema(kinds[what]).parquet(*[at(what, n) for n in numbers]) for what in ("final", "late")}
    return Outcome(whole["final"], spark.read.schema(kinds["held"]).parquet(at("held", max(numbers))), whole["late"])


def _micros(spark, delay: str) -> int:
    zero = "TIMESTAMP '1970-01-01 00:00:00Z'"
    return spark.range(1).select(F.expr(f"unix_micros({zero} + INTERVAL {delay}) - unix_micros({zero})")).first()[0]


def stream_signals(
    lines: DataFrame, ts: str, service: str, classes: dict[str, Column], *, width: str, delay: str, root: str
) -> Outcome:
    """Signal counts per service and tumbling window; a window is final once the watermark has passed its end.

    Open windows are held, and a row of a window that is final already is late. NULL times belong to no window.
    """
    window = F.window(ts, width)

    def fold(rows: DataFrame, held: DataFrame | None, before: Column, now: Column):
        placed = rows.where(F.col(ts).isNotNull()).withColumn("_w", window)
        is_late = F.coalesce(F.unix_micros("_w.end") <= before, F.lit(False))
        counts = placed.where(~is_late).groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), service).agg(
            *[F.count_if(test).alias(name) for name, test in classes.items()]
        )
        if held is not None:
            counts = counts.unionByName(held).groupBy("window_start", "window_end", service).agg(*[F.sum(n).alias(n) for n in classes])
        closed = F.unix_micros("window_end") <= now
        return counts.where(closed), counts.where(~closed), placed.where(is_late).drop("_w")

    return fold_batches(lines, ts, delay, root, fold)


def stream_incidents(signals: DataFrame, keys: list[str], ts: str, *, gap_seconds: int, delay: str, root: str) -> Outcome:
    """Incidents of each key: signals that follow each other within ``gap_seconds``; one is final once the watermark is that far.

    A signal is late if an incident of its own would have been final before it came. NULL times and keys belong to none.
    A batch is clustered by itself, by chunks of time; its clusters and the held ones, few a key, are then joined.
    """
    gap = gap_seconds * 1_000_000

    def ends(column: str) -> Column:
        return F.unix_micros(column) + F.lit(gap)

    def fold(rows: DataFrame, held: DataFrame | None, before: Column, now: Column):
        known = rows.dropna(subset=[*keys, ts])
        is_late = F.coalesce(ends(ts) <= before, F.lit(False))
        clustered = incidents(known.where(~is_late), keys, ts, gap_seconds).groupBy(*keys, "incident").agg(
            F.count("*").alias("n_signals"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
        ).drop("incident")
        if held is not None:
            order = Window.partitionBy(*keys).orderBy("first_seen", "last_seen")
            reached = F.max(F.unix_micros("last_seen")).over(order.rowsBetween(Window.unboundedPreceding, -1))
            opens = F.when(F.unix_micros("first_seen") - reached <= gap, 0).otherwise(1)
            both = clustered.unionByName(held).withColumn("_opens", opens)
            upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            clustered = both.withColumn("_nr", F.sum("_opens").over(upto)).groupBy(*keys, "_nr").agg(
                F.sum("n_signals").alias("n_signals"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
            ).drop("_nr")
        closed = ends("last_seen") <= now
        return clustered.where(closed), clustered.where(~closed), known.where(is_late)

    return fold_batches(signals, ts, delay, root, fold)


def stream_dedupe(rows: DataFrame, keys: list[str], ts: str, *, delay: str) -> DataFrame:
    """The first arrival per key within the watermark; state older than that is let go."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
