"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a run of letters, scored by its strongest feature: character strings of four to six within it, its borders
included, so that inflected and joined forms share what they have in common. A feature's log-odds of toxic against
clean documents is smoothed by a Dirichlet prior in proportion to its total frequency, and counts only if it stands out
from its variance. All other tokens score a small penalty.

One linear scan finds all maximal segments of a text (Ruzzo and Tompa 1999). Segment scores of clean text follow an
extreme-value law in the text's length; its parameters come from clean training texts, turn each score into a p-value,
and the significant ones add up to the evidence that a logistic curve maps to a score from 0 to 1.

A null or empty text has no token and gets the score of no evidence. Repeated rows get equal scores. Without labels of
both kinds every score is 0. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.llm.common import labelled, row_keys, small_batches
from stewardry.llm.minmax import shingle_sets
from stewardry.scale import cut

TOKEN = re.compile(r"[^\W\d_]+")
SIZES = (4, 5, 6)
PENALTY = -0.5
SIGNIFICANT = 0.05
CACHED_TOKENS = 300_000


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def features_of(token: str) -> set[str]:
    framed = f"^{token}$"
    return {framed[i : i + n] for n in SIZES for i in range(len(framed) - n + 1)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # log-odds of the features that stand out
    decay: float = 1.0  # lambda and K of the extreme-value law
    scale: float = 1.0
    slope: float = 0.0  # of the logistic curve over the evidence
    offset: float = -40.0


def maximal_segments(scores: list[float], gaps: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence given by its positive scores and the penalties between them.

    ``gaps[k]`` counts the penalized tokens before the k-th positive one. Gives score, first and last positive token.
    """
    total = 0.0
    found: list[tuple[float, float, int, int]] = []  # total before, total after, first, last
    for k, (score, gap) in enumerate(zip(scores, gaps, strict=True)):
        total += PENALTY * gap
        left, right, first = total, total + score, k
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, k))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(right - left, first, last) for left, right, first, last in found]


class Scorer:
    """Scores texts; remembers the scores of tokens."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def _score(self, token: str) -> float:
        weights = [w for w in map(self.model.weights.get, features_of(token)) if w is not None]
        return max(weights, default=0.0)

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """Score, first and end token of each segment, and the number of tokens."""
        tokens, known = tokens_of(text), self.known
        if len(known) > CACHED_TOKENS:
            known.clear()
        for new in set(tokens).difference(known):
            known[new] = self._score(new)
        at = [k for k, s in enumerate(map(known.__getitem__, tokens)) if s > 0]
        gaps = [b - a - 1 for a, b in zip([-1, *at], at, strict=False)]
        return [(s, at[a], at[b] + 1) for s, a, b in maximal_segments([known[tokens[k]] for k in at], gaps)], len(tokens)

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed evidence of the significant segments, and these with their p-values."""
        segments, n = self.segments(text)
        passages = []
        total = 0.0
        for score, first, end in segments:
            expected = self.model.scale * n * math.exp(-self.model.decay * score)
            p = -math.expm1(-expected)
            if p < SIGNIFICANT:
                passages.append((first, end, p))
                total -= math.log(max(p, 1e-300) / SIGNIFICANT)
        return math.log1p(total), passages

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.model.slope * evidence + self.model.offset))))


def _distinct_texts(sample: DataFrame) -> DataFrame:
    """One of each group of near copies of a bounded sample: copies would make their chance words stand out."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch["text"].to_pylist()], 3)
            least = [[int((s * np.uint64(f)).min()) >> 1 if len(s) else -1 for s in sets] for f in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]
            yield pa.RecordBatch.from_arrays([batch["_k1"], batch["_k2"], *(pa.array(x, pa.int64()) for x in least)], ["_k1", "_k2", "m0", "m1", "m2"])

    keys = sample.select("text", "_k1", "_k2").mapInArrow(sketch, "_k1 long, _k2 long, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        rest = [c for c in keys.columns if c != m]
        keys = keys.groupBy(m).agg(F.min(F.struct(*rest)).alias("_r")).select(m, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return sample.join(F.broadcast(keys.select("_k1", "_k2")), ["_k1", "_k2"], "left_semi")


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most_labelled: int = 20_000, prior: float = 0.2,
    stands_out: float = 3.3, least_odds: float = 2.4, support: int = 5,
) -> Model:
    """A model from at most ``most_labelled`` labelled documents, the bound of all that reaches the driver.

    A feature counts for a document once. The Dirichlet prior weighs ``prior`` times the documents. A feature joins the model if at least ``support`` documents have it, its log-odds
    are ``least_odds`` or more, and ``stands_out`` standard deviations or more.
    """
    small_batches(docs.sparkSession)
    sample = labelled(docs.select("doc_id", "text", *row_keys("doc_id", "text")), labels, label, most_labelled)
    sample = cut(sample, "labelled").select("text", "_k1", "_k2", (F.col("_label") == 1).alias("toxic"))
    sample = cut(_distinct_texts(sample), "distinct")
    sizes = sample.agg(F.sum(F.col("toxic").cast("int")), F.count("*")).first()
    toxic, clean = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
    if not toxic or not clean:
        return Model({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, is_toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                both[is_toxic].update(set().union(*map(features_of, set(tokens_of(text or "")))))
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in both)], ["feature", "clean", "toxic"]
        )

    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")
    ).where(f"c + t >= {support} AND t > 0")
    weight = prior * (toxic + clean)
    share = (F.col("c") + F.col("t")) * prior
    odds = F.log((F.col("t") + share) / (toxic + weight - F.col("t") - share)) - F.log((F.col("c") + share) / (clean + weight - F.col("c") - share))
    chosen = (
        counts.withColumn("odds", odds)
        .withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + share) + 1 / (F.col("c") + share)))
        .where((F.col("odds") >= least_odds) & (F.col("z") >= stands_out))
    )
    model = Model({r["feature"]: r["odds"] for r in chosen.select("feature", "odds").collect()})

    if not model.weights:
        return model

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [scorer.segments(t) for t in texts]
            positive = [sum(scorer.known[x] > 0 for x in tokens_of(t)) for t in texts]
            best_score = [max((s for s, _, _ in segments), default=0.0) for segments, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(best_score), pa.array(positive, pa.int64()), pa.array([n for _, n in found], pa.int64())], ["best", "positive", "n"]
            )

    rows = sample.where("NOT toxic").select("text").mapInArrow(best, "best double, positive long, n long").collect()
    decay, scale = _extreme_law(model, rows)
    model = Model(model.weights, decay, scale)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.evidence(t or "")[0] for t in batch["text"].to_pylist()]), batch["toxic"]], ["evidence", "toxic"])

    pairs = sample.mapInArrow(weigh, "evidence double, toxic boolean").collect()
    slope, offset = _logistic(np.array([p["evidence"] for p in pairs]), np.array([p["toxic"] for p in pairs], dtype=float))
    return Model(model.weights, model.decay, model.scale, slope, offset)


def _extreme_law(model: Model, clean: list) -> tuple[float, float]:
    """Lambda and K from clean texts (best score, positive tokens, tokens).

    Lambda makes the expected exponent of a token's score 1 (Karlin and Altschul 1990). K fits how many of the texts
    reach the score of one middling token.
    """
    tokens = max(1, sum(r["n"] for r in clean))
    share = (sum(r["positive"] for r in clean) + 1) / (tokens + 1)
    weights = np.array(list(model.weights.values()))
    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        grown = share * np.mean(np.exp(middle * weights)) + (1 - share) * math.exp(middle * PENALTY)
        low, high = (middle, high) if grown < 1 else (low, middle)
    bar = float(np.median(weights))
    reached = sum(r["best"] >= bar for r in clean)
    return low, max(1, reached) * math.exp(low * bar) / tokens


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method; the ridge keeps them finite where the classes part cleanly."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``passages``: first token, end token and p-value of each significant segment."""
    small_batches(docs.sparkSession)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    columns = [c for c in docs.columns if c not in ("score", "passages")]
    kept = docs.select(*columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.evidence(t or "") for t in batch["text"].to_pylist()]
            scores = pa.array([scorer.probability(e) if model.weights else 0.0 for e, _ in found], pa.float64())
            spans = pa.array([[{"first": a, "end": b, "p": p} for a, b, p in passages] for _, passages in found], passage)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, spans], [*columns, "score", "passages"])

    span = T.StructType().add("first", "long").add("end", "long").add("p", "double")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(span))])
    return kept.mapInArrow(judge, schema)
