"""URL filters: a short list of host and path rules over a Bloom filter cascade of listed keys (native).

The cascade alternates: its first level encodes the listed keys, the second the unlisted keys of the universe that the
first takes for listed, the third the listed keys that the second takes for unlisted, until a level has no false
positive left. A key is judged by the first level it misses, exactly for every key of the universe, without a join.

A null url, or one without ``://``, has an empty host and path; no rule fits it, and an empty key is never listed.
Repeated urls get equal verdicts. With no listed key the cascade is empty and lists nothing; an empty table stays empty.
Columns of the input are kept; the caller names the new ones, and they replace columns of the same name.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.scale import cut

MOST_HASHES = 16


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def first_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null. The expression grows with the rules: meant for short lists."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        out = out.when(rule.fits(host, path), F.lit(value(rule)))
    return out


@dataclass(frozen=True)
class Level:
    bits: int
    words: str  # the filter's 64-bit words, 16 hexadecimal digits each
    seed: int
    hashes: int

    def holds(self, key: Column) -> Column:
        # the filter is one binary constant of the plan, whatever the number of hashes
        filter_ = F.unhex(F.lit(self.words))

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(filter_, (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
            return F.getbit(byte, F.lit(7) - F.pmod(at, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*_places(key, self.bits, self.seed, self.hashes)), is_set)


def _places(key: Column, bits: int, seed: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * MOST_HASHES + k)), F.lit(bits)) for k in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether ``key`` is listed: exact for the keys of the universe the cascade was built over."""
        out = F.when(F.lit(False), F.lit(False))
        for k, level in enumerate(self.levels):
            out = out.when(~level.holds(key), F.lit(k % 2 == 1))
        return out.otherwise(F.lit(len(self.levels) % 2 == 1))


class TooManyKeys(ValueError):
    """The filter of a level would exceed the bound; join on the keys instead."""


def build(universe: DataFrame, listed: DataFrame, bits_per_key: int = 10, most_bits: int = 1 << 26) -> Cascade:
    """A cascade that tells the keys of ``listed`` from all other keys of ``universe``; both hold one column ``key``.

    The universe is written once with a flag and stays distributed. The driver gets one row per 64 bits of a filter:
    ``most_bits`` bounds it (8 MB, about 6.7 million listed keys), and beyond it ``TooManyKeys`` is raised, for
    which ``is_listed`` has the plain join.
    """
    marked = (
        universe.select("key", F.lit(0).alias("listed"))
        .unionByName(listed.select("key", F.lit(1).alias("listed")))
        .where(F.length("key") > 0)
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    marked = cut(marked, "keys")
    levels: list[Level] = []
    hashes = min(MOST_HASHES, max(1, round(bits_per_key * 0.69)))  # the fewest false positives at this size
    inside, outside = marked.where("listed = 1"), marked.where("listed = 0")
    n = inside.count()
    while n:
        bits = -(-n * bits_per_key // 64) * 64
        if bits > most_bits:
            raise TooManyKeys(f"{n} keys need {bits} bits; the bound is {most_bits}")
        seed = len(levels)
        at = inside.select(F.explode(F.array(*_places(F.col("key"), bits, seed, hashes))).alias("at"))
        # bits of a word from the left, as its hexadecimal digits have them
        rows = (
            at.groupBy((F.floor(F.col("at") / 64)).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(63 - pmod(at, 64) as int))")).alias("bits"))
            .toArrow()
        )
        words = np.zeros(bits // 64, dtype=">i8")
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        levels.append(Level(bits, words.tobytes().hex(), seed, hashes))
        inside, outside = outside.where(levels[-1].holds(F.col("key"))), inside
        n = inside.count()
    return Cascade(tuple(levels))


def is_listed(df: DataFrame, key: str, listed: DataFrame, name: str, **options) -> DataFrame:
    """``df`` with the Boolean ``name``: whether column ``key`` is in ``listed``.

    By a cascade over the distinct keys of ``df``; a list too large for one is joined instead.
    """
    try:
        cascade = build(df.select(F.col(key).alias("key")).distinct(), listed, **options)
    except TooManyKeys:
        known = listed.select(F.col("key").alias("_listed")).where(F.length("_listed") > 0).distinct()
        return df.join(known, df[key] == known["_listed"], "left").withColumn(name, F.col("_listed").isNotNull()).drop("_listed")
    return df.withColumn(name, F.coalesce(cascade.lists(F.col(key)) & (F.length(key) > 0), F.lit(False)))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", whole: bool = False, **options) -> DataFrame:
    """Add host, path, rule and verdict: the longest fitting rule's verdict, else block for a listed key.

    A key is the host, or with ``whole`` host and path.
    """
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("_key", F.concat("host", "path") if whole else F.col("host"))
    out = is_listed(out, "_key", listed, "listed", **options).drop("_key")
    by_rule = first_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    return out.withColumns({
        "rule": first_rule(rules, F.col("host"), F.col("path"), str),
        "verdict": F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))),
    })
