"""Building blocks that keep ordered and iterative work distributed.

The ordered helpers take a ``chunk`` expression that never decreases with the ordering (a day, a
block of line numbers, a block of ids). Work happens inside ``(keys, chunk)``; one small row per
chunk carries the state across chunk borders. A key holding a third of all rows is thus spread over
as many tasks as it has chunks, and the result is the same as one window over the whole key.
Keys and chunk must not be NULL: callers drop or replace such keys first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "_chunk"  # a column of this name is reused, so that helpers in a row share one shuffle
_local_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="stewardry-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what operators write to the shared folder inside this block, when it ends.

    Frames built inside still read those files: write or collect the results before leaving.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, ending its lineage.

    Unlike cached blocks the files outlive lost executors, and their sizes give the planner real
    statistics for the joins that follow.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with at least one task per core, for work that is heavy per row.

    Only a scan of few files is redistributed; one that already has enough tasks stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: How many rows one task is to hold where work on a key needs all of its rows at once.
ROWS_A_TASK = 200_000


def tasks_for(scan: DataFrame) -> int:
    """How many tasks the rows of a table are worth; counting a plain scan reads file footers only."""
    return -(-scan.count() // ROWS_A_TASK)


def dealt(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows dealt out by keys to at least so many tasks, however few shuffle partitions the session has.

    Groups, joins and windows on these keys, or on more, then need no other shuffle, and hold what one task got.
    Up to the session's own number, Spark may put small tasks together.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > own else df.repartition(*keys)


def block_of(number: Column, size: int) -> Column:
    """The first number of the block a whole number lies in (exact for any bigint)."""
    return number - F.pmod(number, F.lit(size))


def _chunked(df: DataFrame, chunk: Column | None) -> DataFrame:
    return df if CHUNK in df.columns else df.withColumn(CHUNK, chunk)


def _made(df: DataFrame) -> list[str]:
    return [] if CHUNK in df.columns else [CHUNK]


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column | None,
    out: str,
) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` (row_number, spread over chunks)."""
    keys = list(keys)
    rows = _chunked(df, chunk)
    local = rows.withColumn(
        "_at", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.count("*").alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        local.join(offsets, [*keys, CHUNK])
        .withColumn(out, (F.col("_at") + F.col("_base")).cast("bigint"))
        .drop("_at", "_base", *_made(df))
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    value: Column,
    out: str,
) -> DataFrame:
    """Add the running sum of ``value`` within ``keys`` in ``order``, spread over chunks."""
    keys = list(keys)
    rows = _chunked(df, chunk).withColumn("_v", value)
    upto = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.sum("_v").alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        rows.withColumn("_run", F.sum("_v").over(upto))
        .join(offsets, [*keys, CHUNK])
        .withColumn(out, (F.col("_run") + F.col("_base")).cast("bigint"))
        .drop("_run", "_base", "_v", *_made(df))
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    columns: Sequence[str],
    out: str,
) -> DataFrame:
    """Add struct ``out`` of ``columns`` of the preceding row within ``keys`` (lag over chunks)."""
    keys, order = list(keys), list(order)
    rows = _chunked(df, chunk)
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    tails = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK)))
        .drop("_tail")
    )
    local = rows.withColumn("_lag", F.lag(F.struct(*columns)).over(here))
    return (
        local.join(tails, [*keys, CHUNK])
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_lag", "_carry", *_made(df))
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], count_as: str | None = None
) -> DataFrame:
    """One row per key, the least by ``order``.

    An aggregate rather than a window: each map task already reduces its rows to one per key, so a
    key with a third of the table sends no more than one row per task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*rest, F.lit(1).alias("_")), F.struct(*order)).alias("_first")]
    if count_as:
        aggs.append(F.count("*").alias(count_as))
    picked = df.groupBy(*keys).agg(*aggs)
    kept = [count_as] if count_as else []
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest], *kept)
