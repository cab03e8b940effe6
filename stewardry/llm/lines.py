"""Line dedup by site-relative frequency: drop the lines that too large a share of a site's pages carries.

A page is a distinct text of a site; copies of one page count once, so that a much copied page is not taken for
boilerplate. A line counts once per page, without the white space around it; blank lines are no lines and stay as they
are. The lines of a site above the ratio are few by arithmetic (their ratios add up to less than the lines of a mean
page), so a site's list is an array beside its pages, and no line is shuffled a second time.

The pages of a site may be counted apart by further columns: where a site mixes languages, a line of one of them can
only be on the pages of that language.

A null text has no lines and stays null; an empty one stays empty. A null site is a site of its own, and so is a null
part of one. Repeated rows are cleaned alike. A line on fewer than ``least_copies`` pages stays, whatever its share: that
is all a small site needs. An empty table gives an empty result. Other columns are kept; ``clean`` overwrites input
columns named ``n_lines`` and ``n_dropped``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import let
from stewardry.scale import cut

RATIO = 0.1
LEAST_COPIES = 3  # what more than a tenth of 20 pages comes to
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, EDGES, "")


def _site_of(site: str, parts: Sequence[str]) -> Column:
    return F.struct(site, *parts) if parts else F.col(site)


def boilerplate(
    docs: DataFrame, site: str, text: str, ratio: float, least_pages: int, parts: Sequence[str], least_copies: int
) -> DataFrame:
    """Per site with any: ``_site`` and ``_lines``, the hashes of the lines on more than ``ratio`` of its pages."""
    lines = F.array_distinct(F.transform(
        F.filter(F.transform(F.split(F.col(text), "\n"), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)
    ))
    pages = docs.where(F.col(text).isNotNull()).select(
        _site_of(site, parts).alias("_site"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), lines.alias("_all")
    )
    pages = cut(pages.groupBy("_site", "_t1", "_t2").agg(F.first("_all").alias("_all")), "pages")
    sites = pages.groupBy("_site").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= least_pages)
    counts = pages.select("_site", F.explode("_all").alias("_line")).groupBy("_site", "_line").agg(F.count("*").alias("_n"))
    found = counts.join(sites.select(F.col("_site").alias("_s"), "_pages"), F.col("_site").eqNullSafe(F.col("_s"))).where(
        (F.col("_n") > ratio * F.col("_pages")) & (F.col("_n") >= least_copies)
    )
    return cut(found.groupBy("_site").agg(F.collect_list("_line").alias("_lines")), "boilerplate")


def clean(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = 1,
    parts: Sequence[str] = (), least_copies: int = LEAST_COPIES,
) -> DataFrame:
    """``docs`` with their boilerplate lines dropped, ``n_lines`` (not blank) and ``n_dropped``."""
    found = boilerplate(docs, site, text, ratio, least_pages, parts, least_copies).withColumnRenamed("_site", "_bp_site")
    joined = docs.join(found, _site_of(site, parts).eqNullSafe(found["_bp_site"]), "left")
    listed = F.coalesce("_lines", F.array().cast("array<bigint>"))
    split = F.transform(
        F.split(F.col(text), "\n"),
        lambda x: let(_trimmed(x), lambda t: F.struct(
            x.alias("line"), (t != "").cast("int").alias("full"), ((t != "") & F.array_contains(listed, F.xxhash64(t))).alias("drop")
        )),
    )
    judged = let(split, lambda s: F.struct(
        F.array_join(F.transform(F.filter(s, lambda x: ~x["drop"]), lambda x: x["line"]), "\n").alias("text"),
        F.aggregate(s, F.lit(0), lambda n, x: n + x["full"]).alias("n_lines"),
        F.size(F.filter(s, lambda x: x["drop"])).alias("n_dropped"),
    ))
    out = joined.withColumn("_judged", judged)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.col("_judged.text").alias(c) if c == text else docs[c] for c in rest],
        F.coalesce("_judged.n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("_judged.n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )
