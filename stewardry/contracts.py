"""Row contracts shared by every check and import operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION_COLUMNS = (
    "policy",
    "kind",
    "object_id",
    "object_name",
    "group_key",
    "severity",
    "reason",
    "suggested_fix",
)
ISSUE_COLUMNS = ("file", "line", "column", "raw", "code", "detail")
SEVERITIES = ("CRITICAL", "ERROR", "WARN", "INFO")


def as_column(value) -> Column:
    """A Column unchanged, a string as a column reference, None as a NULL string."""
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast("string")
    return F.col(value)


def violations(
    df: DataFrame,
    *,
    policy: str,
    kind: str,
    object_id,
    reason,
    object_name=None,
    group_key=None,
    severity: str = "ERROR",
    suggested_fix: str | Column | None = None,
) -> DataFrame:
    """Project offending rows onto the violation contract (a narrow, shuffle-free select)."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}, got {severity!r}")
    fix = suggested_fix if isinstance(suggested_fix, Column) else F.lit(suggested_fix)
    why = reason if isinstance(reason, Column) else F.lit(reason)
    name = object_id if object_name is None else object_name
    return df.select(
        F.lit(policy).alias("policy"),
        F.lit(kind).alias("kind"),
        as_column(object_id).cast("string").alias("object_id"),
        as_column(name).cast("string").alias("object_name"),
        as_column(group_key).cast("string").alias("group_key"),
        F.lit(severity).alias("severity"),
        why.cast("string").alias("reason"),
        fix.cast("string").alias("suggested_fix"),
    )


def issues(df: DataFrame, *, file, line, column: str | Column, raw, code: str, detail) -> DataFrame:
    """Project cells that could not be imported onto the issue contract."""
    text = detail if isinstance(detail, Column) else F.lit(detail)
    name = column if isinstance(column, Column) else F.lit(column)
    return df.select(
        as_column(file).cast("string").alias("file"),
        as_column(line).cast("bigint").alias("line"),
        name.alias("column"),
        as_column(raw).cast("string").alias("raw"),
        F.lit(code).alias("code"),
        text.alias("detail"),
    )
