"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without space, tab, line feed, vertical tab, form feed or carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Records of one Arrow batch: texts may be long, so that a batch of the default 10,000 could not be held.
BATCH_ROWS = 256
#: Characters that a task turns into arrays at once; a longer text is a stretch of its own.
STRETCH = 1 << 22


def words_of(text: Column) -> Column:
    """The words of a text, in order; no words where the text is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit keys ``_k1``, ``_k2`` of a row's content.

    Rows that are equal in ``columns`` share them, and get equal results; no other rows do, at any size in practice.
    """
    return F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("_k2")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is computed once per row, however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers bounded by a few hundred texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stretches(texts: Sequence[str | bytes]) -> Iterator[slice]:
    """Runs of a batch's texts that together are about ``STRETCH`` long, so that arrays over them stay small."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > STRETCH:
            yield slice(first, k)
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``docs`` that have a label, with it as column ``_label``; of at most ``most`` labelled documents.

    The labels are taken in the order of a hash of their id. ``most`` bounds the size of what is broadcast, at
    16 bytes a row. A document with contrary labels, or a null one, is left out.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
        .where("_label = _other")
        .select(F.col("doc_id").alias("_labelled"), "_label")
        .orderBy(F.xxhash64("_labelled"), "_labelled")
        .limit(most)
    )
    return docs.join(F.broadcast(picked), docs["doc_id"] == picked["_labelled"]).drop("_labelled")
