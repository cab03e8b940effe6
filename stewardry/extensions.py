"""User checks, generators and transforms: plain functions on DataFrames, registered by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.contracts import SEVERITIES, VIOLATION_COLUMNS
from stewardry.operators.reconcile import reconcile
from stewardry.sources.sinks import CONTENT_TYPES

Frames = Mapping[str, DataFrame]


@dataclass
class Extensions:
    """Named user functions of the three kinds."""

    checks: dict[str, Callable[[Frames], DataFrame]] = field(default_factory=dict)
    generators: dict[str, Callable[[Frames], Mapping[str, DataFrame]]] = field(default_factory=dict)
    transforms: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def check(self, name: str):
        """Register ``fn(frames) -> violations``; ERROR rows fail it, INFO rows do not."""
        return self._put(self.checks, name)

    def generator(self, name: str):
        """Register ``fn(frames) -> {kind: desired rows}``."""
        return self._put(self.generators, name)

    def transform(self, name: str, content_type: str):
        """Register ``fn(rows) -> DataFrame(target, content)`` giving one content type."""
        if content_type not in CONTENT_TYPES:
            raise ValueError(f"content type {content_type!r} is not one of {CONTENT_TYPES}")

        def register(fn):
            self.transforms[name] = (content_type, fn)
            return fn

        return register

    @staticmethod
    def _put(where: dict, name: str):
        def register(fn):
            where[name] = fn
            return fn

        return register

    def findings(self, frames: Frames, names: Sequence[str] | None = None) -> DataFrame:
        """All rows of the chosen checks, with the check's name."""
        out = None
        for name in names or sorted(self.checks):
            rows = self.checks[name](frames).select(*VIOLATION_COLUMNS).withColumn("check", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no checks registered")
        return out

    def verdicts(self, frames: Frames, names: Sequence[str] | None = None) -> DataFrame:
        """Per check its error and info rows; it passes without ERROR or CRITICAL rows."""
        spark = next(iter(frames.values())).sparkSession
        chosen = list(names or sorted(self.checks))
        listed = spark.createDataFrame([(n,) for n in chosen], "check string")
        bad = F.col("severity").isin(*SEVERITIES[:2])
        counts = self.findings(frames, chosen).groupBy("check").agg(
            F.count_if(bad).alias("_e"), F.count_if(~bad).alias("_i")
        )
        return listed.join(counts, "check", "left").select(
            "check",
            F.coalesce("_e", F.lit(0)).alias("n_errors"),
            F.coalesce("_i", F.lit(0)).alias("n_infos"),
            (F.coalesce("_e", F.lit(0)) == 0).alias("passed"),
        )

    def generate(
        self, name: str, frames: Frames, tracked: Frames, keys: Mapping[str, str], *, allow_empty: bool = False
    ) -> dict[str, DataFrame]:
        """The reconcile plan per kind of a generator's output against what it tracked before."""
        desired = self.generators[name](frames)
        plans = {}
        for kind, rows in desired.items():
            columns = [c for c in rows.columns if c != keys[kind]]
            plans[kind] = reconcile(rows, tracked[kind], keys[kind], columns, allow_empty=allow_empty)
        return plans

    def render(self, name: str, rows: DataFrame) -> DataFrame:
        """``target, content_type, content``: a struct or map becomes JSON, a string stays text."""
        content_type, fn = self.transforms[name]
        out = fn(rows)
        is_text = out.schema["content"].dataType.typeName() == "string"
        content = F.col("content") if is_text else F.to_json("content")
        return out.select("target", F.lit(content_type).alias("content_type"), content.alias("content"))
