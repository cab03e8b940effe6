"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

A window of as many words as a benchmark item gets a fingerprint of blocks of 32 bits. Each block is the SimHash of the
word shingles that fall into its group, by a hash of their own. A shingle that a window and an item do not share changes
its own block and no other, and two of weighted Jaccard similarity 0.8 or more differ in at most a ninth of both their
shingles: that is the radius. An item has more blocks with shingles than its radius, so that as many as it has more are
equal in any window within it: the index looks windows up by each block, and counts. Equal blocks of 32 bits hardly occur
between texts that do not share all shingles of a group, so that a window of other text has next to no candidates, and
one that shares a phrase few. Candidates are verified by the exact Jaccard similarity of their shingles, each weighted by
how often it occurs.

An item that repeats its few shingles so often that it has no more of them than its radius is a candidate of every window
of its size that shares one. A window without any shingle of an item cannot be similar to it, so windows are taken around
the shingles that an item shares; texts without one need no fingerprints.

Items go to the executors in blocks of a bounded number, one pass over the documents per block, so that a benchmark of
any size is searched whole. A null or empty text, or one shorter than a shingle, matches nothing, and neither does an
item with fewer words than a shingle: too little to tell. Equal items are each reported. Repeated rows are reported for
each row. An empty table on either side gives no match. Columns other than those named are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.llm.common import small_batches
from stewardry.llm.debruijn import hash_texts, mixed

SIZE = 5
PERCENT = 80
#: Items of one block: what a pass sends to each executor, about a kilobyte each. All blocks are searched.
BLOCK_ITEMS = 100_000
PREFILTER_BITS = 22
#: Window starts that are fingerprinted at once, or as many as a window is wide.
RUN = 4096


def shingles(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - SIZE + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(SIZE if n else 0):
        total = mixed(total + hashes[k : k + n] + np.uint64(k + 1))
    return total


def radius(n: int) -> int:
    """In how many shingles, and so blocks, two of ``n`` shingles each can differ and still be similar."""
    return 2 * n * (100 - PERCENT) // (100 + PERCENT)


def signs(values: np.ndarray) -> np.ndarray:
    """Per shingle, 32 times plus or minus one."""
    words = np.ascontiguousarray(mixed(values + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32), dtype=np.uint64).astype(np.uint32)
    return np.unpackbits(words.view(np.uint8).reshape(-1, 4), axis=1).astype(np.int32) * 2 - 1


def block_keys(values: np.ndarray, first: np.ndarray, width: int, size: int, n_blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of shingles: the places in ``first`` of the windows that hold some of it, and their keys.

    A key stands for the window size, the group and the SimHash of the window's shingles in it. ``first`` are sorted
    starts of windows of ``width`` shingles.
    """
    group = mixed(values ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n_blocks)
    order = np.argsort(group, kind="stable")
    borders = np.flatnonzero(np.diff(group[order])) + 1
    for at in np.split(order, borders):
        if not len(at):
            continue
        sums = np.zeros((len(at) + 1, 32), dtype=np.int32)
        np.cumsum(signs(values[at]), axis=0, out=sums[1:])
        low, high = np.searchsorted(at, first), np.searchsorted(at, first + width)
        some = np.flatnonzero(high > low)
        bits = np.packbits(sums[high[some]] > sums[low[some]], axis=1).view(np.uint32)[:, 0]
        salt = mixed(np.array([size * 0x10001 + int(group[at[0]]) + 1], dtype=np.uint64))[0]
        yield some, mixed(bits.astype(np.uint64) + salt)


def runs(first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted window starts in runs of close ones, long runs in stretches, so that arrays over a run stay small."""
    reach = max(RUN, width)
    for run in np.split(first, np.flatnonzero(np.diff(first) > width) + 1):
        while len(run):
            some, run = np.split(run, [int(np.searchsorted(run, run[0] + reach))])
            yield some


class Lists:
    """Sorted keys with the sorted values of each, in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
        keys, self.values = keys[new], values[new]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        self.keys, self.begins = keys[firsts], np.r_[firsts, len(keys)]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places in ``wanted`` and values of the key there."""
        if not len(self.keys) or not len(wanted):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == wanted)
        begin, end = self.begins[at[known]], self.begins[at[known] + 1]
        n = end - begin
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(known, n), self.values[np.repeat(begin, n) + inner]


class Index:
    """Benchmark items by their shingles, and by size, group and block of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.sizes: list[int] = []
        found: list[np.ndarray] = []
        for item_id, text in items:
            words, _ = hash_texts([(text or "").lower().encode()])
            own = shingles(words)
            if len(own):
                self.ids.append(item_id)
                self.sizes.append(len(words))
                found.append(own)
        nothing = np.empty(0, dtype=np.uint64)
        self.offsets = np.cumsum([0, *map(len, found)])
        self.shingles = np.concatenate([np.sort(x) for x in found]) if found else nothing
        self.by_shingle = Lists(self.shingles, np.repeat(np.array(self.sizes, dtype=np.int64), np.diff(self.offsets)))
        self.known = self.by_shingle.keys
        self.sieve = np.zeros(1 << PREFILTER_BITS, dtype=bool)
        self.sieve[self.known >> np.uint64(64 - PREFILTER_BITS)] = True
        of_size = defaultdict(list)
        for k, size in enumerate(self.sizes):
            of_size[size].append(k)
        self.n_blocks: dict[int, int] = {}
        self.few: dict[int, np.ndarray] = {}  # items that repeat too few shingles for their radius
        self.needed = np.ones(len(found), dtype=np.int64)  # equal blocks of any window within the radius
        keys, values = [nothing], [np.empty(0, dtype=np.int64)]
        for size, members in of_size.items():
            n = size - SIZE + 1
            least = radius(n) + 1
            enough = [k for k in members if len(np.unique(found[k])) >= least]
            n_blocks = max(least, -(-2 * n // 5) + 2)
            while True:  # more groups until each item has shingles in enough of them
                made = [np.concatenate([key for _, key in block_keys(found[k], np.zeros(1, dtype=np.int64), n, size, n_blocks)]) for k in enough]
                if all(len(x) >= least for x in made) or n_blocks > 8 * n:
                    break
                n_blocks += max(1, n_blocks // 2)
            self.n_blocks[size] = n_blocks
            short = [k for k, x in zip(enough, made, strict=True) if len(x) < least]
            self.few[size] = np.array(sorted({*members} - {*enough} | {*short}), dtype=np.int64)
            for k, x in zip(enough, made, strict=True):
                self.needed[k] = max(1, len(x) - radius(n))
            keys += made
            values += [np.full(len(x), k) for k, x in zip(enough, made, strict=True)]
        self.by_block = Lists(np.concatenate(keys), np.concatenate(values))

    def shared(self, values: np.ndarray) -> np.ndarray:
        """Where a text's shingles are shingles of an item."""
        at = np.flatnonzero(self.sieve[values >> np.uint64(64 - PREFILTER_BITS)])
        if not len(at):
            return at
        some = values[at]
        place = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
        return at[self.known[place] == some]

    def windows(self, values: np.ndarray, n_words: int, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size of the items that share a shingle at ``at``, the starts of the windows that hold it."""
        places, sizes = self.by_shingle.find(values[at])
        for size in np.unique(sizes).tolist():
            p = at[places[sizes == size]]
            low, high = np.maximum(0, p - size + SIZE), np.minimum(p, max(0, n_words - size))
            low = np.minimum(low, high)
            ends = np.maximum.accumulate(high)
            new = np.r_[True, low[1:] > ends[:-1] + 1]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]
            yield size, np.concatenate([np.arange(x, y + 1) for x, y in zip(low[new].tolist(), ends[last].tolist(), strict=True)])

    def candidates(self, values: np.ndarray, n_words: int, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Size, start and items of the windows that have as many blocks in common with an item of that size as it takes."""
        for size, first in self.windows(values, n_words, at):
            width = min(size, n_words) - SIZE + 1
            for some in runs(first, width):
                low = int(some[0])
                part = values[low : int(some[-1]) + width]
                places, items = [np.repeat(np.arange(len(some)), len(self.few[size]))], [np.tile(self.few[size], len(some))]
                for held, keys in block_keys(part, some - low, width, size, self.n_blocks[size]):
                    place, item = self.by_block.find(keys)
                    places.append(held[place])
                    items.append(item)
                pairs, equal = np.unique(np.stack([np.concatenate(places), np.concatenate(items)], axis=1), axis=0, return_counts=True)
                pairs = pairs[equal >= self.needed[pairs[:, 1]]]
                for rows in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
                    if len(rows):
                        yield size, int(some[rows[0, 0]]), rows[:, 1]

    def search(self, values: np.ndarray, n_words: int, at: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """The best window of each similar item: similarity, first word, words. ``at``: where shingles are shared."""
        best: dict[int, tuple[float, int, int]] = {}
        for size, start, items in self.candidates(values, n_words, at):
            width = min(size, n_words) - SIZE + 1
            window, times = np.unique(values[start : start + width], return_counts=True)
            for k in items.tolist():
                own, counts = np.unique(self.shingles[self.offsets[k] : self.offsets[k + 1]], return_counts=True)
                place = np.minimum(np.searchsorted(own, window), len(own) - 1)
                common = int(np.where(own[place] == window, np.minimum(counts[place], times), 0).sum())
                union = width + int(counts.sum()) - common
                if 100 * common >= PERCENT * union:
                    found = (common / union, -start, min(size, n_words))
                    if k not in best or found > best[k]:
                        best[k] = found
        return {k: (s, -start, n) for k, (s, start, n) in best.items()}


def _matches(index: Index, texts: list[str | None]) -> Iterator[dict[int, tuple[float, int, int]]]:
    if not texts:
        return
    hashes, counts = hash_texts([(t or "").lower().encode() for t in texts])
    for words in np.split(hashes, np.cumsum(counts)[:-1]):
        values = shingles(words)
        at = index.shared(values) if len(values) else values
        yield index.search(values, len(words), at) if len(at) else {}


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    n = max(1, -(-items.count() // BLOCK_ITEMS))
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k).select(item_id, text)
        index = Index([(r[0], r[1]) for r in some.collect()])
        if index.ids:
            yield index


def matches(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document row and item found in it: ``doc_id``, ``item_id``, ``first_word``, ``n_words``, ``similarity``."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for made in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [
                    (doc_id, index.ids[k], start, n, s)
                    for doc_id, found in zip(batch["doc_id"].to_pylist(), _matches(index, batch["text"].to_pylist()), strict=True)
                    for k, (s, start, n) in found.items()
                ]
                columns = [pa.array([r[c] for r in rows], pa.float64() if c == 4 else pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    small_batches(docs.sparkSession)
    for made in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _matches(shared.value, batch["text"].to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
