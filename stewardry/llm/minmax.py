"""MinHash near-dedup with min-max hashing: each permutation gives its least and its greatest value.

A text is the set of its word shingles. Both extremes of a permutation agree for two sets with the probability of their
Jaccard similarity, so one hash evaluation serves two places of the signature. Two permutations, four places, make a
band; sets that agree in a band are candidates. With 24 bands a pair at similarity 0.8 is missed with probability
3e-6, and every candidate link is confirmed on the full sets.

No group emits all its pairs. Equal sets are one node. In each bucket the members are compared with one pivot (the
least or the greatest id, in turn by band), linked ones become components, and only members that are still in another
component than some other member are compared further: in small buckets as pairs across components, in large ones in
blocks, the members outside the largest component against all blocks, which yields one link per component met.

A null text, or one without words, has an empty set, links with nothing and stays. A text with fewer words than a
shingle is one shingle. Repeated rows share a set and a component; a null ``doc_id`` counts as larger than any id, and
is kept only if no row with an id is reachable. An empty table gives an empty result. Sets are told apart by a 64-bit
hash of all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.llm.common import row_keys, small_batches, stretches
from stewardry.llm.components import components
from stewardry.llm.debruijn import hash_texts, mixed, packed_texts
from stewardry.scale import cut

BANDS, BAND_PERMUTATIONS = 24, 2
#: Members of one task of a star, of a small bucket, and of one block of a large group; none of them drops a row.
CHUNK, SMALL, BLOCK = 64, 64, 96


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; A-Z are lower-cased."""
    if not texts:
        return []
    out = []
    hashes, counts = hash_texts([t.lower() for t in texts])
    for h in np.split(hashes, np.cumsum(counts)[:-1]):
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - size + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(min(size, len(h))):
            total = mixed(total + h[k : k + n] + np.uint64(k + 1))
        if len(h) < size:
            total = mixed(total ^ np.uint64(len(h)))
        out.append(np.unique(total))
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(sets: list[np.ndarray], bands: int, permutations: int) -> np.ndarray:
    """A key per non-empty set and band, of the least and greatest values of the band's permutations."""
    factor, shift = _permutations(bands * permutations)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    for p in range(bands * permutations):
        hashed = values * factor[p] + shift[p]
        hashed ^= hashed >> np.uint64(32)
        for extreme in (np.minimum.reduceat(hashed, starts), np.maximum.reduceat(hashed, starts)):
            keys[:, p // permutations] = mixed(keys[:, p // permutations] * np.uint64(3) + extreme + np.uint64(p))
    return keys


def sketches(docs: DataFrame, size: int, bands: int, permutations: int) -> DataFrame:
    """Per row: its keys, the number of shingles, the set's hash ``sid`` (null for an empty set) and its band keys."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch["text"].to_pylist()], size)
            all_full = [k for k, s in enumerate(sets) if len(s)]
            sid: list[int | None] = [None] * len(sets)
            rows: list[np.ndarray | None] = [None] * len(sets)
            for some in stretches([sets[k].data for k in all_full]):
                full = all_full[some]
                keys = band_keys([sets[k] for k in full], bands, permutations).view(np.int64)
                for row, k in zip(keys, full, strict=True):
                    sid[k] = int(mixed(np.array([mixed(sets[k] + np.uint64(11)).sum(dtype=np.uint64) + np.uint64(len(sets[k]))])).view(np.int64)[0])
                    rows[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_k1"], batch["_k2"], pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "_k1", "_k2", "n_shingles", "sid", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text", *row_keys("doc_id", "text")).mapInArrow(
        sketch, "doc_id long, _k1 long, _k2 long, n_shingles long, sid long, bands array<long>"
    )


def similar(x: int, y: int, common: np.ndarray | int, percent: int):
    return 100 * common >= percent * (x + y - common)


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a pivot ``a``, a member ``b``) that are similar, from the full sets.

    A pivot's members come to it in chunks, each with a copy of the pivot's set in front; a task holds the pivot's
    set and streams the members. The pairs are read three times and should be written.
    """
    chunks = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    sided = members.join(sets, members["b"] == sets["sid"]).select("a", "chunk", "b", "shingles")
    pivots = chunks.join(sets, chunks["a"] == sets["sid"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("bigint").alias("b"), "shingles"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, raw in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["shingles"], strict=True):
                values = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if b is None:
                    pivot = values.copy()
                elif similar(len(pivot), len(values), _common(pivot, values), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = sided.unionByName(pivots).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large groups (``g``, ``sid``, ``component``) between their largest component, the others, and within.

    The members outside the largest component are compared with all members, block against block; a task holds two
    blocks and yields one link per component that a member meets.
    """
    by = members.groupBy("g", "component").agg(F.count("*").alias("n"))
    largest = by.groupBy("g").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    sized = members.join(largest, "g").select(
        "g", "sid", "component", (F.col("component") != F.col("main")).alias("outside"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("out_blocks"),
    ).where("out_blocks > 0")
    block = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("outside").select("g", block("out_blocks").alias("x"), each("all_blocks").alias("y"), "sid", "component", F.lit(0).alias("side"))
    right = sized.select("g", each("out_blocks").alias("x"), block("all_blocks").alias("y"), "sid", "component", F.lit(1).alias("side"))
    # a plan takes exploded rows for as few as those they come from, and would send them through the driver
    cells = left.unionByName(right).hint("merge").join(sets, "sid").repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "side", "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, rows = None, [], []

        def links() -> Iterator[tuple[int, int]]:
            if not queries or not rows:
                return
            sizes = np.array([len(v) for _, _, v in rows])
            values = np.concatenate([v for _, _, v in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            others = np.array([c for _, c, _ in rows])
            for sid, component, own in queries:
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                if 100 * np.count_nonzero(high > low) < percent * len(own):
                    continue  # too few of its shingles occur in the block at all
                width = high - low
                at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                common = np.bincount(owner[at], minlength=len(rows))
                hit = np.flatnonzero(similar(len(own), sizes, common, percent) & (others != component))
                for k in {others[k]: k for k in hit}.values():
                    yield sid, rows[k][0]

        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch[c].to_pylist() for c in ("g", "x", "y", "side", "sid", "component")]
            for g, x, y, side, sid, component, raw in zip(*columns, batch["shingles"], strict=True):
                if (g, x, y) != cell:
                    found += links()
                    cell, queries, rows = (g, x, y), [], []
                (rows if side else queries).append((sid, component, np.frombuffer(raw.as_py(), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = list(links())
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.mapInArrow(compare, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted rows (``_k1``, ``_k2``, ``sid``), from their whole texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = shingle_sets([unpack(p.as_py()) for p in batch["packed"]], size)
            yield pa.RecordBatch.from_arrays([batch["sid"], pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "shingles"])

    joined = packed_texts(docs).join(wanted, ["_k1", "_k2"]).select("sid", "packed")
    return joined.mapInArrow(build, "sid long, shingles binary")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, permutations: int = BAND_PERMUTATIONS
) -> DataFrame:
    """``doc_id``, row keys, ``n_shingles``, ``component_id``, ``kept`` and ``group`` (null without words) of each row.

    Rows are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.
    ``component_id`` is the least ``doc_id`` reachable, and a row is kept if that is its own.

    What a later step reads more than once is written first, so that no plan holds the steps before it several times:
    the driver's memory goes with the exchanges of a plan, all of which it starts at once, and their partitions.
    """
    rows = cut(sketches(docs, size, bands, permutations), "sketches")
    sets = rows.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("least_id"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"), F.first("bands").alias("bands")
    )
    # each set once, by the band keys of one of its rows
    entries = cut(sets, "sets").select("sid", "_k1", "_k2", "least_id", F.posexplode("bands").alias("band", "key"))
    buckets = (
        entries.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.min("band").alias("band"))
        .where("n > 1")
        .select("key", "n", F.when(F.col("band") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("pivot"))
    )
    # written, so that the join deals both sides anew and a hot bucket can be split over tasks
    met = cut(entries.join(cut(buckets, "bucket-sizes"), "key").select("key", "n", "pivot", "sid", "_k1", "_k2"), "buckets")
    full = cut(_sets_of(docs, met.select("_k1", "_k2", "sid").distinct(), size), "shingle-sets")
    pairs = met.where("sid <> pivot").select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b"), "pivot").groupBy("a", "b").agg(F.min("pivot").alias("pivot"))
    stars = pairs.select(F.col("pivot").alias("a"), F.when(F.col("a") == F.col("pivot"), F.col("b")).otherwise(F.col("a")).alias("b"))
    links = cut(_star_links(cut(stars, "stars"), full, percent), "links")

    # what a pivot has not settled: buckets of three or more with members of different components
    first = cut(components(links), "components")
    placed = met.where("n > 2").join(first, met["sid"] == first["node"], "left").select(
        "key", "n", "pivot", "sid", F.coalesce("component", "sid").alias("component")
    )
    mixed_buckets = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("key")
    open_rows = cut(placed.join(cut(mixed_buckets, "mixed-buckets"), "key"), "open-buckets")
    small = open_rows.where((F.col("n") <= SMALL) & (F.col("sid") != F.col("pivot"))).select("key", "sid", "component")
    other = small.select("key", F.col("sid").alias("b"), F.col("component").alias("_c"))
    across = small.withColumnRenamed("sid", "a").join(other, "key").where("a < b AND component <> _c").select("a", "b").distinct()
    large = open_rows.where(F.col("n") > SMALL)
    groups = components(large.select(F.col("pivot").alias("a"), F.col("sid").alias("b")))
    members = large.select("sid", "component").distinct().join(
        groups.select(F.col("node").alias("sid"), F.col("component").alias("g")), "sid"
    )
    within = cut(_star_links(cut(across, "across"), full, percent), "links")
    beyond = cut(_block_links(cut(members, "members"), full, percent), "links")
    final = components(links.unionByName(within).unionByName(beyond))

    named = cut(sets.select("sid", "least_id"), "named").join(final, F.col("sid") == F.col("node"), "left").select(
        "sid", "least_id", F.coalesce("component", "sid").alias("component")
    )
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_set = cut(named.join(ids, "component").select(F.col("sid").alias("_sid"), "component_id", F.col("component").alias("group")), "groups")
    out = rows.join(by_set, rows["sid"] == by_set["_sid"], "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "_k1", "_k2", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group"
    )


def clean(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked rows: the one of the least ``doc_id``, then of the least key.

    Rows without words are linked with nothing and stay.
    """
    found = near_duplicates(docs, size, percent)
    first = found.where("group IS NOT NULL").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_k1", "_k2")).alias("_f")
    )
    chosen = first.select("_f._k1", "_f._k2", F.lit(True).alias("_one")).unionByName(
        found.where("group IS NULL").select("_k1", "_k2", F.lit(False).alias("_one")).distinct()
    )
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0)))  # rows equal in id and text
    keyed = docs.select(*docs.columns, *row_keys("doc_id", "text")).join(cut(chosen, "chosen"), ["_k1", "_k2"])
    return keyed.withColumn("_nth", nth).where("_nth = 1 OR NOT _one").select(*docs.columns)
