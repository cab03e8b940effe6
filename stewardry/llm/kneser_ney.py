"""Quality by an interpolated modified Kneser-Ney model of character n-grams, one per language.

The model is trained on the trusted text, four documents in five; the fifth, which it has not seen, gives the thresholds,
quantiles of the perplexity of each language. A character is a UTF-16 unit of the lower-cased text with white space made
single spaces; four of them are one 64-bit key, so that contexts and suffixes are shifts and masks. Counts are summed in
the tasks first, then by key; probabilities come from joins of the count tables of neighbouring orders, sharded by
language and key: continuation counts, context totals, discounts and back-off weights.

Each document gets its perplexity per character. Where the tables hold at most ``most_grams`` rows they go to the
executors whole, and a document is scored where it lies; beyond, its n-grams are joined with the sharded tables, order
by order. Both ways give the same perplexity.

A null or empty text has no perplexity and is kept, as is a text of a language without trusted text; a null language
counts as a language of its own. Repeated rows are scored alike. Without trusted documents everything is kept. An
empty table gives an empty result. Columns other than ``doc_id``, ``text`` and ``lang`` are kept unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.llm.common import row_keys, small_batches, stretches
from stewardry.scale import cut

ORDER = 4
#: Trusted ids up to this number are broadcast (16 bytes each); more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Rows of count tables before a task hands them on.
HELD = 1_000_000


def units_of(text: str | None) -> np.ndarray:
    """The characters of a text as numbers, behind three spaces of context; empty for a text without any."""
    plain = " ".join((text or "").lower().split())
    return np.frombuffer(("   " + plain).encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64) if plain else np.zeros(0, np.uint64)


def keys_of(units: np.ndarray) -> np.ndarray:
    return (units[:-3] << np.uint64(48)) | (units[1:-2] << np.uint64(32)) | (units[2:-1] << np.uint64(16)) | units[3:]


def trusted_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The documents that all their labels trust."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_l")).where("_l = 1")
    ids = cut(ids.select(F.col("doc_id").alias("_trusted")), "trusted")
    few = ids.count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_trusted"], "left_semi")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, key, c): how often each character 4-gram occurs in the texts of a language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def summed(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([c for _, c in held[lang]])).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in held:
                keys, counts = summed(lang)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "key", "c"]
                )

        for batch in batches:
            by: dict[str, list[np.ndarray]] = defaultdict(list)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                units = units_of(text)
                if len(units):
                    by[lang or ""].append(keys_of(units))
            for lang, found in by.items():
                held[lang].append(np.unique(np.concatenate(found), return_counts=True))
                if len(held[lang]) >= 16:
                    held[lang] = [summed(lang)]
            if sum(len(k) for v in held.values() for k, _ in v) > HELD:
                yield from rows()
                held.clear()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(count, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def _suffix(key: Column, order: int) -> Column:
    """The last ``order`` characters of a key."""
    return key.bitwiseAND(F.lit((1 << (16 * order)) - 1))


def _context(key: Column) -> Column:
    """All characters of a key but the last."""
    return F.shiftrightunsigned(key, 16)


def model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (lang, key, logp) of the seen n-grams, and (lang, context, logw) of the seen contexts."""
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
        by_order[n] = by_order[n + 1].groupBy("lang", _suffix(F.col("key"), n).alias("key")).agg(F.count("*").alias("c"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    lower = None
    for n in range(1, ORDER + 1):
        grams = cut(by_order[n], f"order-{n}")
        ones = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
        seen = grams.groupBy("lang").agg(*ones, F.count("*").alias("types"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        each = [
            F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.5 * k)))).alias(f"d{k}")
            for k in (1, 2, 3)
        ]
        guarded = seen.withColumns({f"n{k}": F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")) for k in (1, 2, 3, 4)})
        discounts = guarded.select("lang", "types", *each)  # one row per language
        met = grams.join(F.broadcast(discounts), "lang")
        totals = cut(met.groupBy("lang", _context(F.col("key")).alias("context")).agg(
            F.sum("c").alias("total"),
            F.sum(F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).alias("left"),
            F.max("types").alias("types"),
        ), f"contexts-{n}")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = met.drop("types").withColumn("context", _context(F.col("key"))).join(totals, ["lang", "context"])
        weight = F.col("left") / F.col("total")
        if lower is None:
            below = 1 / (F.col("types") + 1)
        else:
            suffix = lower.select("lang", F.col("key").alias("suffix"), F.col("logp").alias("below"))
            joined = joined.withColumn("suffix", _suffix(F.col("key"), n - 1)).join(suffix, ["lang", "suffix"])
            below = F.exp("below")
        p = (F.col("c") - discount) / F.col("total") + weight * below
        lower = cut(joined.select("lang", "key", F.log(p).alias("logp")), f"model-{n}")
        # the order 1 context is empty; its weight goes to characters never seen
        logw = F.log(weight) + (F.log(1 / (F.col("types") + 1)) if n == 1 else F.lit(0.0))
        tables.append((lower, totals.select("lang", "context", logw.alias("logw"))))
    return tables


class Table:
    """Values by 64-bit keys: most by one probe of an open table, the few that collide by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(8 * max(1, len(keys))).bit_length())
        slot = self._slot(keys)
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, np.nan)
        self.keys[slot], self.values[slot] = keys, values
        lost = np.flatnonzero(self.keys[slot] != keys)
        order = lost[np.argsort(keys[lost], kind="stable")]
        self.more, self.more_values = keys[order], values[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, not a number for unknown keys."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], np.nan)
        if len(self.more):
            missed = np.flatnonzero(np.isnan(out))
            at = np.minimum(np.searchsorted(self.more, keys[missed]), len(self.more) - 1)
            out[missed] = np.where(self.more[at] == keys[missed], self.more_values[at], np.nan)
        return out


class Language:
    """The tables of one language; the log-probability of each character behind its three predecessors."""

    def __init__(self, tables: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]):
        self.tables = [(Table(*grams), Table(*contexts)) for grams, contexts in tables]

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            grams, contexts = self.tables[n - 1]
            some = keys[left] & np.uint64((1 << (16 * n)) - 1)
            found = grams.get(some)
            seen = ~np.isnan(found)
            out[left[seen]] += found[seen]
            left, some = left[~seen], some[~seen]
            weight = contexts.get(some >> np.uint64(16))
            out[left] += np.where(np.isnan(weight), 0.0, weight)
        return out


def _perplexity_here(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Perplexities by tables that every executor holds."""
    held: dict[str, list] = {}
    for n, pair in enumerate(tables):
        for side, table in enumerate(pair):
            got = table.toArrow()
            langs = np.array(got["lang"].to_pylist(), dtype=object)
            keys = got.column(1).to_numpy().view(np.uint64)
            values = got.column(2).to_numpy()
            for lang in set(langs.tolist()):
                rows = langs == lang
                held.setdefault(lang, [[None, None] for _ in tables])[n][side] = (keys[rows], values[rows])
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = {lang: Language(t) for lang, t in shared.value.items()}
        for batch in batches:
            out: list[float | None] = [None] * batch.num_rows
            by: dict[str, list[tuple[int, np.ndarray]]] = defaultdict(list)
            for k, (lang, text) in enumerate(zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                units = units_of(text)
                if len(units) and (lang or "") in languages:
                    by[lang or ""].append((k, keys_of(units)))
            for lang, found in by.items():
                for some in stretches([keys.data for _, keys in found]):
                    sizes = np.array([len(keys) for _, keys in found[some]])
                    logs = languages[lang].log_probabilities(np.concatenate([keys for _, keys in found[some]]))
                    sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
                    for (k, _), value in zip(found[some], np.exp(-sums / sizes), strict=True):
                        out[k] = float(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "perplexity"])

    return docs.mapInArrow(judge, T.StructType([*docs.schema, T.StructField("perplexity", T.DoubleType())]))


def _perplexity_joined(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Perplexities by joins of the documents' n-grams with the sharded tables, one order after the other."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lang, text in zip(*(batch[c].to_pylist() for c in ("_k1", "_k2", "lang", "text")), strict=True):
                units = units_of(text)
                if len(units):
                    keys, counts = np.unique(keys_of(units), return_counts=True)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k1] * n), pa.array([k2] * n), pa.array([lang or ""] * n, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                        ["_k1", "_k2", "lang", "key", "n"],
                    )

    keyed = docs.select("*", *row_keys("doc_id", "text", "lang"))
    left = keyed.dropDuplicates(["_k1", "_k2"]).mapInArrow(grams, "_k1 long, _k2 long, lang string, key long, n long").withColumn("log", F.lit(0.0)).withColumn("open", F.lit(True))
    for n in range(ORDER, 0, -1):
        seen, contexts = tables[n - 1]
        some = _suffix(F.col("key"), n) if n < 4 else F.col("key")
        left = left.withColumn("_g", some).join(seen.select("lang", F.col("key").alias("_g"), "logp"), ["lang", "_g"], "left")
        left = left.withColumn("_c", _context(F.col("_g"))).join(contexts.select("lang", F.col("context").alias("_c"), "logw"), ["lang", "_c"], "left")
        more = F.when(F.col("open"), F.coalesce("logp", "logw", F.lit(0.0))).otherwise(F.lit(0.0))
        left = left.select("_k1", "_k2", "lang", "key", "n", (F.col("log") + more).alias("log"), (F.col("open") & F.col("logp").isNull()).alias("open"))
    known = tables[0][1].select("lang").distinct()
    sums = left.join(known, "lang", "left_semi").groupBy("_k1", "_k2").agg(F.exp(-F.sum(F.col("log") * F.col("n")) / F.sum("n")).alias("perplexity"))
    return keyed.join(sums, ["_k1", "_k2"], "left").drop("_k1", "_k2")


def with_perplexity(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]], most_grams: int = 4_000_000) -> DataFrame:
    """``docs`` with ``perplexity`` per character."""
    small_batches(docs.sparkSession)
    rows = sum(t.count() for pair in tables for t in pair)
    return (_perplexity_here if rows <= most_grams else _perplexity_joined)(docs.drop("perplexity"), tables)


def judge(
    docs: DataFrame, labels: DataFrame, label: str = "quality", quantile: float = 0.999, most_grams: int = 4_000_000
) -> DataFrame:
    """``docs`` with ``perplexity``, the ``threshold`` of their language and ``kept``.

    A document goes if its perplexity is above the ``quantile`` of the held-out trusted documents of its language.
    """
    held_out = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5)) == 0
    tables = model(count_grams(trusted_rows(docs.select("doc_id", "lang", "text").where(~held_out), labels, label)))
    scored = cut(with_perplexity(docs.drop("threshold", "kept"), tables, most_grams), "scored")
    bars = trusted_rows(scored.where(held_out & F.col("perplexity").isNotNull()).select("doc_id", "lang", "perplexity"), labels, label).groupBy(
        F.coalesce("lang", F.lit("")).alias("_lang")
    ).agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))  # one row per language
    out = scored.join(F.broadcast(bars), F.coalesce(scored["lang"], F.lit("")) == bars["_lang"], "left").drop("_lang")
    return out.withColumn("kept", ~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)))
