"""An import from delimited files to a load set: read, map, coerce, check, gate, write. Nothing is written past an open issue.

A draft is lazy but for the header mapping. Its issues are rows; the user's answers come back as rows of decisions,
which close the issues they name on the next run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions.coerce import blank_to_null, to_boolean, to_datetime, to_number
from stewardry.functions.text import map_columns
from stewardry.operators.checks import fail_closed
from stewardry.operators.joins import closure
from stewardry.scale import cut, first_per_key
from stewardry.sources.delimited import read_delimited
from stewardry.sources.sinks import write_load_set

ISSUES = "kind string, file string, line long, column string, code string, cell string"


@dataclass(frozen=True)
class Attribute:
    name: str
    label: str = ""
    type: str = "Text"  # Text, Number, Integer, Boolean or DateTime
    optional: bool = True
    refers: str | None = None  # the kind whose key the cell names


@dataclass(frozen=True)
class Kind:
    name: str
    key: str
    attributes: tuple[Attribute, ...]


@dataclass(frozen=True)
class Draft:
    frames: Mapping[str, DataFrame]  # coerced rows by kind, the first of each key
    issues: DataFrame
    references: tuple[tuple[str, str], ...]  # kind and the kind it refers to


def _coerced(cell: Column, kind: str, decimal: Column) -> Column:
    if kind == "Text":
        return cell
    if kind == "Boolean":
        return to_boolean(cell)
    if kind == "DateTime":
        return to_datetime(cell)
    number = F.when(decimal == ",", to_number(cell, ",")).otherwise(to_number(cell))
    if kind == "Number":
        return number
    if kind == "Integer":
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    raise ValueError(f"unknown attribute type {kind!r}")


def _mapping(spark: SparkSession, headers: Mapping[str, Sequence[str]], kinds: Mapping[str, Kind]) -> DataFrame:
    """kind, header, attribute, status; one row per header cell of the kinds."""
    cells = [(k, h) for k, row in headers.items() for h in row]
    attributes = [(k.name, a.name, a.label or a.name) for k in kinds.values() for a in k.attributes]
    return map_columns(
        spark.createDataFrame(cells, "kind string, header string"),
        spark.createDataFrame(attributes, "kind string, name string, label string"),
        scope=["kind"],
    )


def draft(
    spark: SparkSession, sources: Mapping[str, Sequence[str]], kinds: Sequence[Kind], decisions: DataFrame | None = None,
) -> Draft:
    """Rows of each kind from its files, and every issue that keeps them from being loaded.

    Codes: ``unmapped`` and ``ambiguous`` (header cells), ``required_blank``, ``not_a_<type>``, ``conflict`` (rows of one
    key that differ), ``orphan`` (a reference to no row of its kind). ``decisions`` (kind, column, code) closes issues: a
    column decided away is left out, another decided issue lets its rows through, a bad cell as NULL.
    """
    known = {k.name: k for k in kinds}
    raw = {name: read_delimited(spark, paths, with_decimal=True) for name, paths in sources.items()}
    own = ("_file", "_line", "_input_rank", "_decimal")
    headers = {name: [c for c in rows.columns if c not in own] for name, rows in raw.items()}
    mapped = cut(_mapping(spark, headers, known), "mapping")
    bound = {(r["kind"], r["header"]): r["attribute"] for r in mapped.where("status = 'mapped'").collect()}
    nothing = F.lit(None).cast("string")
    issues = mapped.where("status <> 'mapped'").select(
        "kind", nothing.alias("file"), F.lit(None).cast("bigint").alias("line"), F.col("header").alias("column"), F.col("status").alias("code"), nothing.alias("cell")
    )
    frames, keys, wanted = {}, [], []
    for name, rows in raw.items():
        attributes = {a.name: a for a in known[name].attributes}
        by_attribute = {bound[name, h]: h for h in headers[name] if (name, h) in bound}
        cells = rows.select(*own, *[blank_to_null(F.col(f"`{h}`")).alias(a) for a, h in by_attribute.items()])
        found = []
        for a in attributes.values():
            cell = F.col(a.name) if a.name in by_attribute else nothing
            if not a.optional or a.name == known[name].key:
                found.append(F.when(cell.isNull(), F.struct(F.lit(a.name).alias("column"), F.lit("required_blank").alias("code"), nothing.alias("cell"))))
            if a.type != "Text" and a.name in by_attribute:
                bad = cell.isNotNull() & _coerced(cell, a.type, F.col("_decimal")).isNull()
                found.append(F.when(bad, F.struct(F.lit(a.name).alias("column"), F.lit(f"not_a_{a.type.lower()}").alias("code"), cell.alias("cell"))))
        if found:
            issues = issues.unionByName(
                cells.select("_file", "_line", F.explode(F.array_compact(F.array(*found))).alias("i")).select(
                    F.lit(name).alias("kind"), F.col("_file").alias("file"), F.col("_line").alias("line"), "i.*"
                )
            )
        typed = cells.select(*own, *[_coerced(F.col(a), attributes[a].type, F.col("_decimal")).alias(a) for a in by_attribute])
        key = known[name].key
        if key not in by_attribute:
            frames[name] = typed.drop(*own)
            continue
        values = [F.xxhash64(*by_attribute)] if by_attribute else []
        clash = typed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(values[0]).alias("a"), F.max(values[0]).alias("b")).where("a <> b")
        issues = issues.unionByName(
            clash.select(
                F.lit(name).alias("kind"), nothing.alias("file"), F.lit(None).cast("bigint").alias("line"),
                F.lit(key).alias("column"), F.lit("conflict").alias("code"), F.col(key).cast("string").alias("cell"),
            )
        )
        # input order decides between rows of one key
        frames[name] = first_per_key(typed.where(F.col(key).isNotNull()), [key], ["_input_rank", "_line"]).drop(*own)
        keys.append(typed.select(F.lit(name).alias("kind"), F.col(key).cast("string").alias("key")))
        for a in by_attribute:
            if attributes[a].refers:
                wanted.append(
                    typed.select(F.lit(name).alias("from"), F.lit(a).alias("column"), F.lit(attributes[a].refers).alias("kind"), F.col(a).cast("string").alias("key"))
                )
    if wanted and keys:
        emitted, refs = keys[0], wanted[0]
        for more in keys[1:]:
            emitted = emitted.unionByName(more)
        for more in wanted[1:]:
            refs = refs.unionByName(more)
        orphans = closure(refs, emitted.distinct())
        named = refs.select("from", "column", "kind", "key").distinct().join(orphans, ["kind", "key"])
        issues = issues.unionByName(
            named.select(F.col("from").alias("kind"), nothing.alias("file"), F.lit(None).cast("bigint").alias("line"), "column", F.lit("orphan").alias("code"), F.col("key").alias("cell"))
        )
    if decisions is not None:
        issues = issues.join(decisions.select("kind", "column", "code").distinct(), ["kind", "column", "code"], "left_anti").select(*issues.columns)
    references = tuple(sorted({(k.name, a.refers) for k in kinds for a in k.attributes if a.refers}))
    return Draft(frames, issues, references)


def emit(ready: Draft, path: str) -> dict[str, str]:
    """Write the load set of a draft without open issues below ``path``; gives each kind its load prefix.

    Open issues are written to ``<path>-issues`` instead, a bounded report of them is raised, and no file is emitted.
    """
    fail_closed(ready.issues, "open issues", report=f"{path}-issues")
    return write_load_set(ready.frames, ready.references, path)
