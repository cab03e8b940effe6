"""Substring dedup: repeated word windows found in a compacted de Bruijn graph of k-word edges.

Windows of ``width`` words are the graph's edges, and a path of them is compacted where it is read: the windows of a
text that share their least k-word string (the anchor) form one path piece, hashed as a whole. Equal windows have equal
anchors at equal places, so all copies of a window lie in pieces of one anchor. Spark joins settle the pieces:

* an anchor seen once has no repeated window;
* an anchor whose pieces are all equal is a nonbranching path, and every window of its copies is repeated;
* an anchor with different pieces branches. One copy of each of these pieces is opened into its windows, the windows
  are counted over all branches, and the counts go back to every copy of the piece;
* of the pieces settled whole, one whose only successor has no other predecessor is joined with it, so that a text's
  walk along nonbranching links becomes one long repeated span, wherever its coordinates show that it walks on.

Source coordinates (document, first word, windows) travel with each piece and mark the words in the end. Identities
are hashes of 128 bits: the anchor's and the piece's, or two of a window.

A null or empty text has no words. A text shorter than ``width`` words has no window and stays whole. Repeated rows are
copies of each other, so their windows are repeated. An empty table gives an empty result. Only ``doc_id``, which may
be null, and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.llm.common import STRETCH, row_keys, small_batches, stretches
from stewardry.scale import cut

K = 8
PLACE_BITS = 28  # positions within one Arrow batch
MARKED = 62  # windows whose marks are the bits of one number
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses modulo 2**64


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one text after the other, and how many words each has.

    A word's hash is a polynomial of random values of its bytes, mixed with its length.
    """
    data = b" ".join(texts)
    hashes, starts, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)  # no word runs over a space
        end = len(data) if end < 0 else end
        found, places = _hash_words(np.frombuffer(data, np.uint8, end - at, at))
        hashes.append(found)
        starts.append(places + at)
        at = end
    borders = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), borders), prepend=0)


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one stretch of bytes."""
    full = ~_SPACE[data]
    edge = np.diff(full.view(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    up = _powers_of(BASES[1], int(lengths.max()))[0]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = np.add.reduceat(_BYTES[data[full]] * up[place], firsts)
    return mixed(values + lengths.astype(np.uint64) * np.uint64(BASES[0])), starts


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, ``n`` or more."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 18)
        _powers[base] = tuple(
            np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
            for b in (base, pow(base, -1, 1 << 64))
        )
    return _powers[base]


class Rolling:
    """Hashes of any stretch of a sequence of word hashes, from running sums of powers modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _powers_of(base, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)])])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(1))

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of that length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(1))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, reach = values, 1
    while reach * 2 <= width:
        out, reach = np.minimum(out[:-reach], out[reach:]), reach * 2
    return np.minimum(out[: len(values) - width + 1], out[width - reach : len(values) - reach + 1])


def pieces(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Path pieces of some texts: text number, first window, windows, anchor hash, piece hash."""
    values, lengths = hash_texts(texts)
    total = len(values)
    none = np.zeros(0, dtype=np.int64)
    if total < width:
        return none, none, none, none, none
    text_of = np.repeat(np.arange(len(texts)), lengths)
    rolling = Rolling(values, BASES[0])
    grams = rolling.all(K)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchors = (_least((grams & ~low) | place, width - K + 1) & low).astype(np.int64)
    n = total - width + 1
    valid = text_of[:n] == text_of[width - 1 :]
    first = valid.copy()
    first[1:] &= (anchors[1:] != anchors[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    windows = np.flatnonzero(last) - starts + 1
    whole = mixed(rolling.of(starts, windows + (width - 1)) + windows.astype(np.uint64))
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = text_of[starts]
    return text, starts - begin[text], windows, grams[anchors[starts]].view(np.int64), whole.view(np.int64)


def path_pieces(docs: DataFrame, width: int) -> DataFrame:
    """A row per path piece of every text with its source coordinates."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            for some in stretches(texts):
                text, start, windows, anchor, whole = pieces(texts[some], width)
                rows = pa.array(text + some.start)
                yield pa.RecordBatch.from_arrays(
                    [batch["_k1"].take(rows), batch["_k2"].take(rows), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(anchor), pa.array(whole)],
                    ["_k1", "_k2", "start", "windows", "anchor", "piece"],
                )

    return docs.select("text", *row_keys("doc_id", "text")).mapInArrow(
        read, "_k1 long, _k2 long, start int, windows int, anchor long, piece long"
    )


def packed_texts(docs: DataFrame) -> DataFrame:
    """The texts with their keys, compressed for the shuffle that follows."""
    small_batches(docs.sparkSession)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [squeeze((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_k1"], batch["_k2"], pa.array(packed, pa.binary())], ["doc_id", "_k1", "_k2", "packed"]
            )

    schema = "doc_id long, _k1 long, _k2 long, packed binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text", *row_keys("doc_id", "text")).mapInArrow(compress, schema)


def _opened(texts: DataFrame, branches: DataFrame, width: int) -> DataFrame:
    """The windows of one copy of each branching piece, each with its place in the piece."""
    wanted = branches.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "windows", "anchor", "piece", "copies")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, lists in zip(batch["packed"], batch["wanted"], strict=True):
                values, _ = hash_texts([unpack(packed.as_py())])
                found = lists.values
                start, windows = (found.field(k).to_numpy() for k in ("start", "windows"))
                which = np.repeat(np.arange(len(start)), windows)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = start[which] + offset
                hashes = [Rolling(values, base).of(at, width).view(np.int64) for base in BASES]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, hashes), pa.array(offset, pa.int32()), *(found.field(k).take(pa.array(which)) for k in ("anchor", "piece", "copies"))],
                    ["w1", "w2", "offset", "anchor", "piece", "copies"],
                )

    schema = "w1 long, w2 long, offset int, anchor long, piece long, copies long"
    return texts.join(wanted, ["_k1", "_k2"]).select("packed", "wanted").mapInArrow(read, schema)


def marks(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Source coordinates of all repeated stretches: first window, windows, and which of these (bit k: the k-th)."""
    read = path_pieces(docs, width)
    anchors = (
        read.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("piece").alias("least"), F.max("piece").alias("most"))
        .where("n > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("branches"))
    )
    # written, so that the join deals both sides anew and a hot anchor's pieces can be split over tasks
    repeated = cut(read.join(cut(anchors, "anchors"), "anchor"), "repeated-pieces")
    branches = (
        repeated.where("branches").groupBy("anchor", "piece", "windows")
        .agg(F.count("*").alias("copies"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"), F.first("start").alias("start"))
    )
    opened = cut(_opened(texts, branches, width), "windows")
    counted = opened.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2")
    # a piece of a wide window has more windows than a number has bits: they are marked in runs
    settled = opened.join(counted, ["w1", "w2"]).groupBy("anchor", "piece", F.expr(f"offset div {MARKED}").alias("run")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, offset % {MARKED})")).alias("which")
    )
    settled = cut(settled, "settled")
    branching = repeated.where("branches").join(settled, ["anchor", "piece"]).select(
        "_k1", "_k2", (F.col("start") + F.col("run") * MARKED).alias("start"), "windows", "which"
    )
    return _compacted(repeated.where("NOT branches")).unionByName(branching)


def _compacted(pieces: DataFrame) -> DataFrame:
    """Long spans in place of the pieces of nonbranching paths; ``which`` is null, as all their windows are repeated."""
    walk = Window.partitionBy("_k1", "_k2").orderBy("start")
    after = F.lag("piece").over(walk), F.lag(F.col("start") + F.col("windows")).over(walk)
    walked = pieces.select(
        "_k1", "_k2", "start", "windows", "piece", F.when(after[1] == F.col("start"), after[0]).alias("before")
    )
    walked = cut(walked, "walked")
    steps = walked.where("before IS NOT NULL")
    onward = steps.groupBy("before").agg(F.min("piece").alias("piece"), F.max("piece").alias("_other")).where("piece = _other")
    backward = steps.groupBy("piece").agg(F.min("before").alias("before"), F.max("before").alias("_other")).where("before = _other")
    links = cut(onward.select("before", "piece").join(backward.select("before", "piece"), ["before", "piece"]), "links")
    joined = walked.join(links.select("piece", F.col("before").alias("_link")), "piece", "left")
    fresh = F.when(F.col("before") == F.col("_link"), 0).otherwise(1)
    return (
        joined.select("_k1", "_k2", "start", "windows", F.sum(fresh).over(walk).alias("span"))
        .groupBy("_k1", "_k2", "span")
        .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("windows")) - F.min("start")).alias("windows"))
        .select("_k1", "_k2", "start", "windows", F.lit(None).cast("bigint").alias("which"))
    )


def remove(docs: DataFrame, width: int = 35) -> DataFrame:
    """Each document without the words that lie in a window of ``width`` words found twice or more.

    Gives ``doc_id``, ``text`` (the kept words joined by one space), ``n_words``, ``n_removed`` and ``spans``, the
    removed stretches as first word and end.
    """
    texts = packed_texts(docs)
    found = marks(docs, texts, width).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "windows", "which")).alias("marks"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept_texts, counts, removed, spans = [], [], [], []
            for packed, lists in zip(batch["packed"], batch["marks"], strict=True):
                words = unpack(packed.as_py()).split()
                edges: list[tuple[int, int]] = []
                if lists.is_valid:
                    start, windows = (lists.values.field(k).to_numpy() for k in ("start", "windows"))
                    which = lists.values.field("which")
                    whole = which.is_null().to_numpy(zero_copy_only=False)
                    at, bit = np.nonzero((which.fill_null(0).to_numpy()[:, None] >> np.arange(min(width, MARKED))) & 1)
                    begins = np.concatenate([start[at] + bit, start[whole]])
                    ends = np.concatenate([start[at] + bit + width, start[whole] + windows[whole] + width - 1])
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, begins, 1)
                    np.add.at(change, ends, -1)
                    covered = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
                    turns = np.flatnonzero(np.diff(covered))
                    edges = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
                counts.append(len(words))
                removed.append(sum(b - a for a, b in edges))
                spans.append([{"start": a, "end": b} for a, b in edges])
                for a, b in reversed(edges):
                    del words[a:b]
                kept_texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kept_texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)],
                ["doc_id", "text", "n_words", "n_removed", "spans"],
            )

    schema = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>"
    return texts.join(found, ["_k1", "_k2"], "left").select("doc_id", "packed", "marks").mapInArrow(drop, schema)
