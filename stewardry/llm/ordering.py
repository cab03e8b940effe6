"""Places of rows in the order of a key, without a task that holds the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.scale import cut

_ROW_BITS = 33  # monotonically_increasing_id numbers the rows of a partition in its lower 33 bits


def positions(rows: DataFrame, key: str, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``position``, from 0, in the ``order`` within ``key``, and ``n``, the rows of that key.

    One range sort over all rows: a key, and even equal rows, run over as many partitions as they fill, as a written
    random number settles ties. A row per key and partition carries the counts over. ``key`` must not be null; nulls
    come first in ``order``. Both inputs of the sort are written, so that a lost executor changes no place.
    """
    at, part = F.col("_at"), F.shiftright("_at", _ROW_BITS).alias("_part")
    salted = cut(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), label)
    by = [key, *order, "_salt"]
    placed = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed, f"{label}-sorted")
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(key, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("n")
    )
    return placed.select("*", part).join(runs, [key, "_part"]).select(
        *rows.columns, (at - F.col("_first") + F.col("_base")).alias("position"), "n"
    )
