"""Desired against actual state, merging and decomposing inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.scale import block_of, first_per_key, ranked


class EmptyDesiredState(RuntimeError):
    """The desired state is empty, which would delete everything tracked."""


class ConflictingState(RuntimeError):
    """Desired rows contradict each other."""


def design_diff(
    expected: DataFrame, actual: DataFrame, key: str, attributes: Sequence[str] = ()
) -> DataFrame:
    """``missing``, ``extra`` and ``mismatch`` rows between a design and the realised objects."""
    # of equal keys the least row is kept: the same one however often a task runs
    whole = F.min(F.struct(F.lit(1).alias("_"), *attributes))
    left = expected.groupBy(key).agg(whole.alias("_e"))
    right = actual.groupBy(key).agg(whole.alias("_a"))
    differing = F.array_compact(
        F.array(
            F.lit(None).cast("string"),
            *[F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in attributes],
        )
    )
    status = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), "extra")
        .when(F.size(differing) > 0, "mismatch")
    )
    return (
        left.join(right, key, "full_outer")
        .select(
            key,
            status.alias("status"),
            F.when(status == "mismatch", F.array_join(differing, ",")).alias("attributes"),
        )
        .where(F.col("status").isNotNull())
    )


def merge_inputs(inputs: Sequence[DataFrame]) -> DataFrame:
    """Inputs of one kind under each other, numbered in the given order; missing columns are NULL."""
    out = None
    for rank, df in enumerate(inputs):
        numbered = df.withColumn("input_rank", F.lit(rank))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one input is needed")
    return out


def reconcile(
    desired: DataFrame, actual: DataFrame, key: str, columns: Sequence[str], *, allow_empty: bool = False
) -> DataFrame:
    """The action per key: ``create``, ``update``, ``keep``, ``delete`` or ``conflict``.

    The columns are the state to write: the desired ones, NULL included, and the actual ones of a key
    that is deleted. Desired rows that differ under one key, or have no key, are a ``conflict`` and
    change nothing; equal ones count once. Anything tracked and no longer produced is deleted, so an
    empty desired state fails unless ``allow_empty``; that test reads at most one row.
    """
    if not allow_empty and desired.isEmpty():
        raise EmptyDesiredState("desired state is empty; pass allow_empty=True to delete everything")
    whole = F.struct(F.lit(1).alias("_"), *columns)
    want = desired.groupBy(key).agg(F.min(whole).alias("_d"), F.max(whole).alias("_other"))
    have = actual.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(whole).alias("_a"))
    clash = F.col("_d").isNotNull() & (F.col(key).isNull() | ~F.col("_d").eqNullSafe(F.col("_other")))
    action = (
        F.when(clash, "conflict")
        .when(F.col("_a").isNull(), "create")
        .when(F.col("_d").isNull(), "delete")
        .when(F.col("_d").eqNullSafe(F.col("_a")), "keep")
        .otherwise("update")
    )
    stays = F.col("_d").isNull() | (clash & F.col("_a").isNotNull())
    return want.join(have, key, "full_outer").select(
        key,
        action.alias("action"),
        *[F.when(stays, F.col(f"_a.{c}")).otherwise(F.col(f"_d.{c}")).alias(c) for c in columns],
    )


def apply_plan(plan: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Write the state after a reconcile as a new version; the old files are never touched."""
    if not plan.where(F.col("action") == "conflict").isEmpty():
        raise ConflictingState("desired rows differ under one key, or have none; nothing is written")
    plan.where(F.col("action") != "delete").select(key, *columns).write.parquet(path)


def insert_only(
    desired: DataFrame, actual: DataFrame, key: str, *, kind: str
) -> tuple[DataFrame, DataFrame]:
    """New rows, and the rejected ones with a readable reason."""
    known = actual.select(key)
    fresh = desired.join(known, key, "left_anti")
    reason = F.concat(F.lit(f"{kind} with {key} "), F.col(key).cast("string"), F.lit(" already exists"))
    return fresh, desired.join(known, key, "left_semi").withColumn("reason", reason)


@dataclass(frozen=True)
class Part:
    """One kind inside a wide sheet: its key columns, and sheet column -> attribute name."""

    kind: str
    keys: Sequence[str]
    columns: Mapping[str, str]


def decompose(sheet: DataFrame, parts: Sequence[Part], order: Sequence[str]) -> dict[str, DataFrame]:
    """One frame per kind, parents deduplicated on their key, first row in ``order`` winning.

    A referrer lists its parent's key among its own columns. Pass the parts parents first.
    """
    out: dict[str, DataFrame] = {}
    for part in parts:
        kept = sheet.select(
            *[F.col(c).alias(n) for c, n in part.columns.items()],
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        ).dropna(subset=[part.columns[k] for k in part.keys])
        names = [part.columns[k] for k in part.keys]
        marks = [f"_o{i}" for i in range(len(order))]
        out[part.kind] = first_per_key(kept, names, marks).drop(*marks)
    return out


def nest_components(
    children: DataFrame,
    parent: str,
    *,
    kind: str,
    columns: Sequence[str | Column],
    order: Sequence[str],
    chunk: Column,
    block_size: int = 10_000,
) -> DataFrame:
    """Children as ``{kind, data[]}`` per parent, in blocks of at most ``block_size``.

    ``block`` is the position of its first child, so a parent with more children gets further rows; loading them one after
    the other gives the same objects, and no task ever holds an unbounded list.
    """
    placed = ranked(children, [parent], list(order), chunk, "_pos").withColumn(
        "block", block_of(F.col("_pos") - 1, block_size)
    )
    return (
        placed.groupBy(parent, "block")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", F.struct(*columns).alias("row")))).alias("_l"))
        .select(
            parent,
            "block",
            F.struct(
                F.lit(kind).alias("kind"), F.transform("_l", lambda x: x["row"]).alias("data")
            ).alias("children"),
        )
    )


def missing_outputs(expected: DataFrame, produced: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Every expected item with its score; an item without output scores zero."""
    joined = expected.select(*keys).distinct().join(produced.select(*keys, score), list(keys), "left")
    return joined.withColumn("produced", F.col(score).isNotNull()).withColumn(
        score, F.coalesce(F.col(score), F.lit(0)).cast(produced.schema[score].dataType)
    )
