import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n_words string, start string"


def invented(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def rows() -> list[tuple]:
    """Normal, null, empty, blank, one-word, repeated, near-copied and very long texts, and null ids; extra columns clash."""
    base = invented(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = " ".join(words[20:70])
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "One  two\n\nthree "),
        (10, invented(2, 90) + "\n" + passage + "\n" + invented(3, 40)), (11, invented(4, 30_000)), (12, "ab " * 400),
        (12, "ab " * 400), (None, base), (None, None), (13, "É Σ 😀  x\x85y <|endoftext|> \r\n\x0b\x0c z"),
        (14, "\n".join([invented(5, 12)] * 6)), (15, passage.upper()), (16, invented(6, 34)), (17, invented(6, 34)), (18, invented(6, 35)),
    ]
    return [(i, t, ("en", None, "de")[k % 3], ("a", "b", None)[k % 3], None if t is None else len(t), "x", "y", "z", "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
