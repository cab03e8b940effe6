"""Language of a text: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A subword is a string of two to four letters of a word, its borders included, or a whole short word; it is hashed into a
table of embeddings. A text is the average of its subwords' embeddings; a linear layer and a softmax give languages.
Both are trained by stochastic gradient descent in numpy, on at most ``most`` documents of known language, as many of
each language as there is room for. A fifth of them is held back: it sets the temperature of the softmax, and the two
bars of rejection, the least score and the least share of subwords that training met, so that a stated share of
documents of a known language falls below each.

A text that is null or has no letter is ``und`` with score 0 and rejected. Equal texts get equal results. Ties go to the
first language by its bytes. Without any training document all is ``und``. An empty table gives an empty result. Other
columns are kept, but for those of the results' names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stewardry.llm.common import row_keys, small_batches
from stewardry.scale import cut

SIZES = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
LEAST_STEPS = 4_000  # of the descent, which few documents need more rounds for
PIECE = 1 << 18  # characters that are hashed at once
NONE = "und"


@cache
def _kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark that belongs to its word, 0 anything else."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            kinds[code] = 2
        elif code > 0x2FF and unicodedata.category(c)[0] == "M":
            kinds[code] = 1
    return kinds


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Buckets of the subwords of a run of code points, in which every other character is a single blank (0)."""
    found = []
    h = codes.astype(np.uint32) + np.uint32(1)
    for size in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ (codes[size - 1 :].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(size))
        if not len(h):
            break
        inner = np.ones(len(h), dtype=bool)
        for k in range(1, size - 1):
            inner &= codes[k : k + len(h)] != 0
        if size == 2:  # a border alone says nothing
            inner &= (codes[: len(h)] != 0) | (codes[1 : 1 + len(h)] != 0)
        picked = h[inner]
        picked = (picked ^ (picked >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append((picked ^ (picked >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def subwords(text: str) -> np.ndarray:
    """How often each bucket is hit by the subwords of a whole text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    kinds = _kinds()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    carried = np.zeros(1, dtype=np.uint32)  # the end of the last piece, from its last blank on
    overlap = max(SIZES) - 1
    for first in range(0, max(1, len(codes)), PIECE):
        piece = codes[first : first + PIECE]
        piece = np.where(kinds[piece] > 0, piece, 0)
        joined = np.concatenate([carried, piece])
        if first + PIECE >= len(codes):
            joined = np.append(joined, np.uint32(0))
        keep = np.r_[True, (joined[1:] != 0) | (joined[:-1] != 0)]
        joined = joined[keep]
        counts += np.bincount(_hashed(joined), minlength=BUCKETS)
        # the next piece begins with the last characters, whose own subwords are counted already
        carried = joined[-overlap:]
        counts -= np.bincount(_hashed(carried), minlength=BUCKETS) if first + PIECE < len(codes) else 0
    return counts


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    embeddings: np.ndarray  # BUCKETS x DIMENSIONS
    weights: np.ndarray  # DIMENSIONS x languages
    bias: np.ndarray
    met: np.ndarray  # buckets that training met
    temperature: float = 1.0
    least_score: float = 0.0
    least_share: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(counts)
        n = counts[hit]
        return (n @ self.embeddings[hit] / max(1, n.sum())) @ self.weights + self.bias

    def known(self, counts: np.ndarray) -> float:
        return float(counts[self.met].sum() / max(1, counts.sum()))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        if text is None or not self.languages or not has_letter(text):
            return NONE, 0.0, True
        counts = subwords(text)
        p = _softmax(self.logits(counts) / self.temperature)
        best = int(np.argmax(p))
        score = float(min(1.0, p[best]))
        return self.languages[best], score, score < self.least_score or self.known(counts) < self.least_share


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_languages: int, rounds: int, rate: float) -> tuple[np.ndarray, ...]:
    """Embeddings, weights and bias by stochastic gradient descent; a row is its buckets and their shares."""
    rng = np.random.default_rng(12)
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, n_languages)), np.zeros(n_languages)
    # each language weighs the same, however many documents it has
    share = len(labels) / (n_languages * np.bincount(labels, minlength=n_languages).clip(1))
    steps, step = rounds * len(rows), 0
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            hit, shares = rows[k]
            pace = rate * (1 - step / steps) * min(3.0, share[labels[k]])
            step += 1
            mean = shares @ embeddings[hit]
            error = _softmax(mean @ weights + bias)
            error[labels[k]] -= 1
            back = weights @ error
            weights -= pace * np.outer(mean, error)
            bias -= pace * 0.1 * error
            # a text has many subwords, each of which is a small part of it: the step is per subword, not per text
            embeddings[hit] -= (pace * len(hit) ** 0.5 * shares)[:, None] * back
    return embeddings, weights, bias


def sample(docs: DataFrame, most: int, most_languages: int) -> DataFrame:
    """``text`` and ``lang`` of at most ``most`` documents with both, as many of each language as of any other at most.

    Of more than ``most_languages`` languages the most frequent ones are taken. The order is that of a hash of the text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", *row_keys("lang", "text"))
    keys = cut(known.select("lang", "_k1", "_k2").distinct(), "language-keys")
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()
    if not sizes:
        return known
    room = max(1, most // len(sizes))
    # about twice the room by the hash alone, so that what is ordered is small
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2 * room / r["n"]))])[F.col("lang")]
    some = keys.where(F.pmod("_k2", F.lit(1 << 30)) < share * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_k1", "_k2"))
    picked = some.withColumn("_nth", nth).where(F.col("_nth") <= room).select("_k1", "_k2")
    return known.join(F.broadcast(picked), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])


def learn(
    docs: DataFrame, most: int = 3_000, most_languages: int = 300, rounds: int = 8, rate: float = 0.5, rejected: float = 0.005,
) -> Model:
    """A model from ``text`` and ``lang`` of at most ``most`` documents, the bound of all that reaches the driver.

    A document comes to the driver as counts by bucket. ``rejected`` is the share of known documents below each bar.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [subwords(t) for t in batch["text"].to_pylist()]
            hits = [np.flatnonzero(c).astype("<u2") for c in counted]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["lang"], batch["_k1"], pa.array([h.tobytes() for h in hits], pa.binary()),
                    pa.array([c[h].astype("<u4").tobytes() for c, h in zip(counted, hits, strict=True)], pa.binary()),
                ],
                ["lang", "_k1", "hits", "counts"],
            )

    spread = sample(docs, most, most_languages)
    found = spread.mapInArrow(count, "lang string, _k1 long, hits binary, counts binary").orderBy("_k1", "lang", "hits").collect()
    rows, labels = [], []
    languages = tuple(sorted({r["lang"] for r in found if r["hits"]}, key=str.encode))
    for r in found:
        if r["hits"]:
            hit, n = np.frombuffer(r["hits"], dtype="<u2").astype(np.int64), np.frombuffer(r["counts"], dtype="<u4")
            rows.append((hit, n / n.sum(), n))
            labels.append(languages.index(r["lang"]))
    none = np.zeros((BUCKETS, DIMENSIONS))
    if not rows:
        return Model((), none, np.zeros((DIMENSIONS, 0)), np.zeros(0), np.zeros(BUCKETS, dtype=bool))
    y = np.array(labels)
    held = np.arange(len(rows)) % 5 == 4
    held &= np.bincount(y[~held], minlength=len(languages))[y] > 0  # no language is only held back
    train = np.flatnonzero(~held)
    rounds = max(rounds, LEAST_STEPS // len(train))
    parts = _descend([rows[k][:2] for k in train], y[train], len(languages), rounds, rate)
    met = np.zeros(BUCKETS, dtype=bool)
    for k in train:
        met[rows[k][0]] = True
    model = Model(languages, *parts, met)
    checked = np.flatnonzero(held)
    if not len(checked):
        return model
    dense = np.zeros(BUCKETS, dtype=np.int64)
    logits, shares = [], []
    for k in checked:
        dense[rows[k][0]] = rows[k][2]
        logits.append(model.logits(dense))
        shares.append(model.known(dense))
        dense[rows[k][0]] = 0
    logits = np.array(logits)
    # the temperature under which the held-back documents are likeliest; never below 1, as few documents may all be right
    grid = np.geomspace(1, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(checked)), y[checked]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    scores = _softmax(logits / temperature).max(axis=1)
    return Model(languages, *parts, met, temperature, float(np.quantile(scores, rejected)), float(np.quantile(shares, rejected)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` from 0 to 1 and ``rejected``."""
    small_batches(docs.sparkSession)
    added = ["lang_pred", "score", "rejected"]
    columns = [c for c in docs.columns if c not in added]
    kept = docs.select(*columns)
    small = Model(  # the table goes to the tasks once, in the size that the scores need
        model.languages, model.embeddings.astype(np.float32), model.weights, model.bias, model.met,
        model.temperature, model.least_score, model.least_share,
    )
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            judged = [known.judge(t) for t in batch[text].to_pylist()]
            new = [pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64()), pa.array([j[2] for j in judged], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*columns, *added])

    schema = T.StructType([
        *kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())
    ])
    return kept.mapInArrow(judge, schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of a key's text leaves ``part`` when divided by ``parts``; false for null."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))
