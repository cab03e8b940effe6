"""Packing along a space-filling curve: similar documents become neighbours and share sequences.

A document is tokenized, its tokens are hashed into a signed vector, the vector is projected to four dimensions, and
their Hilbert key orders all documents. Along that order the tokens are one stream, cut every ``length`` tokens. Only
the last stretch of the stream is shorter; it is cut into powers of two, so that no sequence needs padding.

Each document is tokenized once, and its ids are written compressed. The rows that are sorted and summed hold no
tokens; the compressed ids are shuffled once, to meet their place in the stream.

A null or empty text is its end token alone. Repeated rows are packed each for itself, one after the other. An empty
table gives no pieces. Only ``doc_id``, which may be null, and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.llm.common import row_keys, small_batches
from stewardry.scale import cut

DIMENSIONS, BITS, BUCKETS = 4, 10, 256
END = 0  # the id that ends each document
BLANK_RUN = 1 << 16
BLANKS = re.compile(r"\s+")


class Tokenizer:
    """Token ids by the byte-level BPE of a tokenizers file.

    With ``added`` the strings of the file's added tokens get their own ids, as its library does by itself; without,
    they are ordinary text. Where the file's merges are in the order of its ids, tiktoken gives the same ids from the
    same vocabulary in a quarter of the time; any other file, and a text with such a string, is left to the library. So
    is a text with a run of more than ``BLANK_RUN`` blanks, on which tiktoken's expressions run out of stack.
    """

    #: Fixed value: how byte-level BPE splits a text before it merges.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, added: bool = False):
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        self.own.encode_special_tokens = not added
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.added = [t["content"] for t in described.get("added_tokens", ()) if added or not t["special"]]
        self.fast = self._ranks(described)

    def _ranks(self, described: dict):
        model, split = described["model"], described["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and split["use_regex"]
            and not split["add_prefix_space"] and described["normalizer"] is None and not model["dropout"]
        )
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        if not plain or any(model["vocab"].get(x + y) != 256 + k for k, (x, y) in enumerate(pairs)):
            return None
        import tiktoken

        # byte-level BPE writes a byte as its own character if that can be printed, and else as one from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items()}
        return tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        if any(x in text for x in self.added):
            return False
        return len(text) <= BLANK_RUN or all(m.end() - m.start() <= BLANK_RUN for m in BLANKS.finditer(text))

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and self._plain(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")


_tokenizers: dict[tuple[str, bool], Tokenizer] = {}


def tokens(path: str, texts: list[str | None], added: bool = False) -> list[np.ndarray]:
    """Token ids of each text with the end token; a process keeps one tokenizer per file and way."""
    if (path, added) not in _tokenizers:
        _tokenizers[path, added] = Tokenizer(path, added)
    end = np.array([END], dtype="<u4")
    return [np.concatenate([_tokenizers[path, added].encode(t or ""), end]) for t in texts]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of whole points below 2**bits (Skilling 2004), as one number each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    z = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed token vector."""
    plane = np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))
    vectors = np.zeros((len(ids), BUCKETS))
    for k, doc in enumerate(ids):
        h = _mixed(doc)
        place = (h % np.uint64(BUCKETS)).astype(np.int64)
        sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
        counts = np.bincount(place, weights=sign, minlength=BUCKETS)
        vectors[k] = np.sign(counts) * np.sqrt(np.abs(counts))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = (vectors / np.maximum(norms, 1e-12)) @ plane  # each about normal with variance 1
    cells = np.clip((1 / (1 + np.exp(-1.7 * at))) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def tokenized(docs: DataFrame, path: str, added: bool = False) -> DataFrame:
    """Per row: ``doc_id``, keys, Hilbert key ``curve``, ``n`` tokens and the compressed ids. Written once, then read."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = tokens(path, batch["text"].to_pylist(), added)
            kind = "<u2" if max((int(x.max()) for x in ids), default=0) < 1 << 16 else "<u4"
            packed = [bytes([int(kind[-1])]) + squeeze(x.astype(kind).tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_k1"], batch["_k2"], pa.array(curve_keys(ids), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "_k1", "_k2", "curve", "n", "packed"],
            )

    schema = "doc_id long, _k1 long, _k2 long, curve long, n long, packed binary"
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", *row_keys("doc_id", "text")).mapInArrow(read, schema)
    return cut(rows, "tokens")


def order(measured: DataFrame) -> DataFrame:
    """One row per distinct document row: keys, ``doc_tokens``, ``start`` in the stream of all tokens, their ``total``.

    A range sort by curve key gives the order; running sums within its partitions, and over one row per partition,
    give the starts. Copies of a row follow each other.
    """
    distinct = measured.groupBy("_k1", "_k2").agg(F.min("curve").alias("curve"), F.min("n").alias("n"), F.count("*").alias("copies"))
    distinct = cut(distinct, "measured")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch["n"].to_numpy() * batch["copies"].to_numpy()
            ends = at + np.cumsum(sizes)
            starts = ends - sizes
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays(
                [batch["_k1"], batch["_k2"], batch["n"], pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), pa.array([part] * len(sizes), pa.int32())],
                ["_k1", "_k2", "n", "size", "local", "part"],
            )

    ordered = (
        distinct.repartitionByRange("curve", "_k1", "_k2").sortWithinPartitions("curve", "_k1", "_k2")
        .mapInArrow(add_up, "_k1 long, _k2 long, n long, size long, local long, part int")
    )
    ordered = cut(ordered, "ordered")
    sums = ordered.groupBy("part").agg(F.sum("size").alias("size"))  # a row per sorted partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "part",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.sum("size").over(Window.partitionBy()).alias("total"),
    )
    return ordered.join(F.broadcast(bases), "part").select(
        "_k1", "_k2", (F.col("base") + F.col("local")).alias("start"), F.col("n").alias("doc_tokens"), "total"
    )


def _edges(length: int, total: int) -> tuple[int, np.ndarray]:
    """Where full sequences end, and the borders of the powers of two behind."""
    full = total // length * length
    borders, at = [full], full
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        borders.append(at)
    return full, np.array(borders, dtype=np.int64)


def pack(docs: DataFrame, path: str, length: int = 1024, added: bool = False) -> DataFrame:
    """One row per piece: the document, its place there, the sequence and the place there, and the token ids.

    Pieces of one document run over consecutive sequences; each sequence is filled without a gap. ``added``: the
    strings of the file's added tokens get their own ids.
    """
    measured = tokenized(docs, path, added)
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))) - 1
    placed = measured.select("doc_id", "_k1", "_k2", "packed").join(order(measured), ["_k1", "_k2"]).select(
        "doc_id", "packed", (F.col("start") + nth * F.col("doc_tokens")).alias("start"), "total"
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            at = batch["start"].to_numpy()
            totals = batch["total"].to_numpy()
            for doc_id, packed, first, total in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist(), at.tolist(), totals.tolist(), strict=True):
                ids = np.frombuffer(unpack(packed[1:]), dtype=f"<u{packed[0]}").astype("<u4")
                full, borders = _edges(length, total)
                done = 0
                while done < len(ids):
                    here = first + done
                    if here < full:
                        number, begin, end = here // length, here // length * length, here // length * length + length
                    else:
                        k = int(np.searchsorted(borders, here, side="right")) - 1
                        number, begin, end = full // length + k, int(borders[k]), int(borders[k + 1])
                    some = ids[done : done + end - here]
                    for name, value in (
                        ("doc_id", doc_id), ("start", done), ("length", len(some)), ("ids", some.tobytes()),
                        ("doc_tokens", len(ids)), ("sequence_id", number), ("offset", here - begin),
                    ):
                        out[name].append(value)
                    done += len(some)
            kinds = {"ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(pieces, schema)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids, little-endian 32-bit, in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def checksum(ids: np.ndarray) -> int:
    """The same for ids in memory."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
