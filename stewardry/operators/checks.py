"""Filters and per-row policies (typed lookup, patterns, membership, presence, types, bounds)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.contracts import violations
from stewardry.functions.coerce import ISO_DATETIME
from stewardry.scale import cut


class UnknownFilter(ValueError):
    """A filter names an attribute or relation the kind does not have."""


class GateClosed(RuntimeError):
    """A gate found rows that forbid the write that follows."""


@dataclass(frozen=True)
class Relation:
    """An equi-join from a kind to its peer kind: ``local`` column = peer's ``remote`` column."""

    peer: DataFrame
    local: str
    remote: str
    relations: Mapping[str, "Relation"] = field(default_factory=dict)


def _matches(column: Column, value, partial: bool) -> Column:
    if isinstance(value, (list, tuple, set)):
        return column.isin(list(value))
    if partial:
        return F.contains(column.cast("string"), F.lit(str(value)))
    return column == F.lit(value)


def get_nodes(
    nodes: DataFrame,
    filters: Mapping[str, object],
    *,
    relations: Mapping[str, Relation] | None = None,
    id_column: str,
    hfid: Sequence[str] = (),
    label: Column | None = None,
    partial_match: bool = False,
    include_attributes: bool = False,
) -> DataFrame:
    """Nodes of one kind by ``<attr>__value``, ``<rel>__..__<attr>__value``, ``ids`` and ``hfid``.

    Relation filters become left-semi joins with the filtered peer, so only matching peers travel.
    An unknown key is an error, never an empty result. Without ``include_attributes`` the result is
    the id and the display label.
    """
    relations = relations or {}
    by_relation: dict[str, dict[str, object]] = {}
    out = nodes
    for key, value in filters.items():
        if key == "ids":
            out = out.where(F.col(id_column).isin(list(value)))
            continue
        if key == "hfid":
            if len(value) != len(hfid):
                raise UnknownFilter(f"hfid needs {len(hfid)} parts, got {len(value)}")
            for name, part in zip(hfid, value, strict=True):
                out = out.where(F.col(name) == F.lit(part))
            continue
        head, _, rest = key.partition("__")
        if rest == "value" and head in nodes.columns:
            out = out.where(_matches(F.col(head), value, partial_match))
        elif rest and head in relations:
            by_relation.setdefault(head, {})[rest] = value
        else:
            raise UnknownFilter(f"unknown filter {key!r}; attributes: {nodes.columns}")
    for name, nested in by_relation.items():
        rel = relations[name]
        peers = get_nodes(
            rel.peer,
            nested,
            relations=rel.relations,
            id_column=rel.remote,
            partial_match=partial_match,
            include_attributes=True,
        ).select(F.col(rel.remote).alias("_peer"))
        out = out.join(peers, F.col(rel.local) == F.col("_peer"), "left_semi")
    if include_attributes:
        return out
    shown = F.col(id_column).cast("string") if label is None else label
    return out.select(id_column, shown.alias("display_label"))


def search_nodes(
    nodes: DataFrame, text: str, *, order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Rows where any attribute, read as text, contains ``text``; a limit keeps a stable order."""
    values = F.array(*[F.col(c).cast("string") for c in nodes.columns])
    hits = nodes.where(F.exists(values, lambda v: F.coalesce(F.contains(v, F.lit(text)), F.lit(False))))
    return hits if limit is None else hits.orderBy(*order).limit(limit)


def page(
    df: DataFrame, *, order: Sequence[str | Column], limit: int, offset: int = 0, after: Sequence | None = None
) -> DataFrame:
    """One page of rows with the total over the unpaged set and whether more rows follow.

    ``after`` holds the last key of the page before (columns in ascending order), in place of an offset: such a page costs the same
    wherever it lies, while an offset gathers all rows before it in one task. The total is a scalar subquery (a partial count per task), not an unpartitioned window.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    if after is not None:
        keys = df.select(*order)
        last = F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(after, keys.dtypes, strict=True)])
        rest = df.where(F.struct(*keys.columns) > last)
        left = rest.agg(F.count("*").alias("n")).scalar()
        rows = rest.orderBy(*order).limit(limit).withColumn("total_count", total)
        return rows.withColumn("_left", left).withColumn("has_more", F.col("_left") > limit).drop("_left")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    counted = rows.withColumn("total_count", total)
    return counted.withColumn("has_more", F.col("total_count") > F.lit(offset + limit))


def regex_conformance(
    df: DataFrame, column: str, pattern: str, *, policy: str, kind: str, object_id, **contract
) -> DataFrame:
    """Rows whose value does not match the anchored pattern; a NULL value is a violation."""
    bad = df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))
    reason = F.concat(F.lit("does not match pattern "), F.lit(pattern))
    return violations(bad, policy=policy, kind=kind, object_id=object_id, reason=reason, **contract)


def membership(
    df: DataFrame,
    column: str,
    allowed: DataFrame,
    *,
    policy: str,
    kind: str,
    object_id,
    allowed_column: str,
    scope: str | None = None,
    allowed_scope: str | None = None,
    **contract,
) -> DataFrame:
    """Rows whose value is outside the approved set (per scope when given); NULL is no violation.

    A left-anti join: a small approved set is broadcast by the planner on its measured size, a large
    one is shuffled and a hot value is split by the adaptive skew rule.
    """
    names = [F.col(allowed_column).alias("_allowed")]
    condition = F.col(column) == F.col("_allowed")
    if scope:
        names.append(F.col(allowed_scope or scope).alias("_scope"))
        condition = condition & (F.col(scope) == F.col("_scope"))
    approved = allowed.select(*names).distinct()
    bad = df.where(F.col(column).isNotNull()).join(approved, condition, "left_anti")
    reason = F.concat(F.col(column).cast("string"), F.lit(" is not in the approved set"))
    return violations(bad, policy=policy, kind=kind, object_id=object_id, reason=reason, **contract)


def is_absent(df: DataFrame, column: str) -> Column:
    """NULL, an empty collection or a blank string."""
    data_type = df.schema[column].dataType
    col = F.col(column)
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return col.isNull() | (F.size(col) == 0)
    if isinstance(data_type, T.StringType):
        return col.isNull() | (F.trim(col) == "")
    return col.isNull()


def presence(df: DataFrame, column: str, *, policy: str, kind: str, object_id, **contract) -> DataFrame:
    """Rows where the required relation or attribute is absent."""
    return violations(
        df.where(is_absent(df, column)),
        policy=policy,
        kind=kind,
        object_id=object_id,
        reason=f"no {column} assigned",
        **contract,
    )


def type_conformance(
    df: DataFrame, document: str, declared: Mapping[str, str], *, policy: str, kind: str, object_id,
    **contract,
) -> DataFrame:
    """Attributes of a JSON document whose value is not of the declared type.

    Boolean must be a JSON boolean, Number a JSON number (a boolean is none), DateTime an ISO string,
    JSON a parsed object or array. An attribute the document lacks is not inspected.
    """
    rows = df.withColumn("_doc", F.try_parse_json(document))

    def broken(name: str, wanted: str) -> Column:
        value = F.try_variant_get("_doc", f"$.{name}", "variant")
        found = F.schema_of_variant(value)
        if wanted == "Boolean":
            ok = found == "BOOLEAN"
        elif wanted == "Number":
            ok = found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        elif wanted == "DateTime":
            text = F.try_variant_get("_doc", f"$.{name}", "string")
            ok = (found == "STRING") & text.rlike(ISO_DATETIME)
        elif wanted == "JSON":
            ok = found.rlike("^(OBJECT|ARRAY)")
        else:
            raise ValueError(f"unknown declared type {wanted!r}")
        label = F.lit(f"{name} is not a {wanted}")
        return F.when(value.isNotNull() & ~F.coalesce(ok, F.lit(False)), label)

    tests = F.array_compact(F.array(*[broken(n, w) for n, w in declared.items()]))
    bad = rows.select("*", F.explode(tests).alias("_reason")).drop("_doc")
    return violations(
        bad, policy=policy, kind=kind, object_id=object_id, reason=F.col("_reason"), **contract
    )


@dataclass(frozen=True)
class Constraint:
    """Declared bounds of one attribute; unset bounds are not tested."""

    column: str
    regex: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    excluded_values: str | None = None
    enum: Sequence[object] | None = None

    def tests(self) -> list[Column]:
        col = F.col(self.column)
        found: list[tuple[str, Column]] = []
        if self.regex is not None:
            found.append(("regex", ~col.rlike(self.regex)))
        if self.min_length is not None:
            found.append(("min_length", F.length(col) < self.min_length))
        if self.max_length is not None:
            found.append(("max_length", F.length(col) > self.max_length))
        if self.min_value is not None:
            found.append(("min_value", col < F.lit(self.min_value)))
        if self.max_value is not None:
            found.append(("max_value", col > F.lit(self.max_value)))
        if self.excluded_values is not None:
            hit = F.lit(False)
            for part in self.excluded_values.split(","):
                low, high = re.fullmatch(r"\s*(-?[^-\s]+)\s*(?:-\s*(-?[^-\s]+))?\s*", part).groups()
                hit = hit | col.between(float(low), float(high or low))
            found.append(("excluded_values", hit))
        if self.enum is not None:
            found.append(("enum", ~col.isin(list(self.enum))))
        return [F.when(bad, F.lit(f"{self.column}: {rule}")) for rule, bad in found]


def param_constraints(
    df: DataFrame, constraints: Sequence[Constraint], *, policy: str, kind: str, object_id, **contract
) -> DataFrame:
    """One violation per row and broken bound, found in a single pass without a shuffle."""
    tests = [test for constraint in constraints for test in constraint.tests()]
    bad = df.select("*", F.explode(F.array_compact(F.array(*tests))).alias("_reason"))
    return violations(
        bad, policy=policy, kind=kind, object_id=object_id, reason=F.col("_reason"), **contract
    )


def unmapped_columns(headers: DataFrame, mapping: DataFrame, *, column: str = "column") -> DataFrame:
    """Header cells no attribute or recorded decision covers."""
    return headers.join(mapping.select(column).distinct(), column, "left_anti")


def fail_closed(found: DataFrame, what: str, *, show: int = 20, report: str | None = None) -> None:
    """Raise before any write when ``found`` has rows; names the first ``show`` of them and counts all.

    Whatever their number, no more than these reach the driver. With ``report`` all of them are written there
    first, and nothing if there are none.
    """
    if report is not None:
        held = cut(found, "findings")
        if not held.isEmpty():
            held.write.json(report)
        found = held
    first = found.limit(show + 1).collect()
    if first:
        total = len(first) if len(first) <= show else found.count()
        listed = "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in first[:show])
        more = f"; and {total - show} more" if total > show else ""
        raise GateClosed(f"{total} {what}: {listed}{more}")


def as_subtype(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of a generic union that carry the fields only one concrete kind has."""
    present = F.lit(True)
    for name in fields:
        present = present & F.col(name).isNotNull()
    return df.where(present)


def omit_nulls(columns: Sequence[str | Column]) -> Column:
    """A JSON object without the keys whose value is NULL."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
