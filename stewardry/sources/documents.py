"""Object documents, nested responses, manifests, log bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.functions.coerce import to_json_value
from stewardry.sources.delimited import numbered_lines


def explode_documents(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """Rows ``(keep.., kind, row)`` of object envelopes held as JSON text, one object or an array.

    A document that does not parse, is no object, or whose ``spec.data`` is no list gives no rows;
    rows that are no objects are skipped.
    """
    parsed = to_json_value(F.col(document))
    kind_of = lambda v: F.schema_of_variant(v)
    many = F.when(kind_of(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
    one = F.when(kind_of(parsed).startswith("OBJECT"), F.array(parsed))
    docs = df.select(*keep, F.posexplode(F.coalesce(many, one)).alias("doc_ix", "_d"))
    rows = docs.select(
        *keep,
        "doc_ix",
        F.try_variant_get("_d", "$.spec.kind", "string").alias("kind"),
        F.explode(F.try_variant_get("_d", "$.spec.data", "array<variant>")).alias("row"),
    )
    return rows.where(kind_of(F.col("row")).startswith("OBJECT"))


def _plain(name: str) -> str:
    return name.strip("_") if name.startswith("__") or name.endswith("__") else name


def _flatten(col: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        inner = data_type.elementType
        return F.transform(col, lambda x: _flatten(x, inner))
    if not isinstance(data_type, T.StructType):
        return col
    names = data_type.fieldNames()
    if names == ["value"]:
        return _flatten(col["value"], data_type["value"].dataType)
    if names == ["node"]:
        return _flatten(col["node"], data_type["node"].dataType)
    if names == ["edges"]:
        empty = F.array().cast(_flat_type(data_type["edges"].dataType))
        return F.coalesce(_flatten(col["edges"], data_type["edges"].dataType), empty)
    return F.when(
        col.isNotNull(), F.struct(*[_flatten(col[f.name], f.dataType).alias(_plain(f.name)) for f in data_type])
    )


def _flat_type(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_flat_type(data_type.elementType))
    if not isinstance(data_type, T.StructType):
        return data_type
    if data_type.fieldNames() in (["value"], ["node"], ["edges"]):
        return _flat_type(data_type[0].dataType)
    return T.StructType([T.StructField(_plain(f.name), _flat_type(f.dataType)) for f in data_type])


def flatten_response(df: DataFrame) -> DataFrame:
    """Take ``value``, ``node`` and ``edges`` wrappers off; absent edges become an empty array.

    Only the schema is walked; the result is one projection.
    """
    return df.select(*[_flatten(F.col(f.name), f.dataType).alias(_plain(f.name)) for f in df.schema])


# A manifest lists its collectors with their outcome.
MANIFEST = "collected_at string, collectors array<struct<name:string,status:string,error:string>>"


def read_manifest(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """One row per collector; those that did not end ``ok`` are findings of their own."""
    parsed = F.from_json(document, MANIFEST)
    return (
        df.select(*keep, parsed.alias("_m"))
        .select(*keep, "_m.collected_at", F.explode("_m.collectors").alias("_c"))
        .select(
            *keep,
            "collected_at",
            F.col("_c.name").alias("collector"),
            F.col("_c.status").alias("status"),
            F.col("_c.error").alias("error"),
            (~F.col("_c.status").eqNullSafe("ok")).alias("is_finding"),
        )
    )


LOG_PATH = r"logs/([^/]+)/([^/]+?)(\.previous)?\.log\z"
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)Z?\s+(?:\[?([A-Z]+)\]?:?\s+)?(.*)"


def read_log_bundle(spark: SparkSession, path: str) -> DataFrame:
    """All lines of ``logs/<service>/<replica>[.previous].log`` with service, replica and time."""
    return read_log_lines(spark, f"{path.rstrip('/')}/logs/*/*.log", LOG_PATH)


def read_log_lines(spark: SparkSession, files: str, layout: str) -> DataFrame:
    """Log lines of all files, never a sample; ``layout`` takes service, replica and the mark of a
    previous log out of the path. A line without a time keeps NULL there."""
    lines = numbered_lines(spark, [files]).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    level = F.regexp_extract("value", LOG_LINE, 2)
    return lines.select(
        F.regexp_extract("_path", layout, 1).alias("service"),
        F.regexp_extract("_path", layout, 2).alias("replica"),
        (F.regexp_extract("_path", layout, 3) != "").alias("is_previous"),
        F.col("_line").cast("bigint").alias("line_no"),
        F.try_to_timestamp(F.translate(F.regexp_extract("value", LOG_LINE, 1), "T,", " .")).alias("ts"),
        F.when(level != "", level).alias("level"),
        F.when(F.col("value").rlike(LOG_LINE), F.regexp_extract("value", LOG_LINE, 3))
        .otherwise(F.col("value"))
        .alias("msg"),
    )
