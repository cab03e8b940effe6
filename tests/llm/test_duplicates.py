"""Near-duplicates and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from stewardry import scale
from stewardry.llm import common, debruijn, minmax
from stewardry.llm.components import components
from tests.llm.conftest import invented, rows


def plain_sets(data, size):
    out = []
    for _, text in data:
        words = (text or "").encode().lower().split()
        out.append(frozenset(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else []))
    return out


def plain_components(data, size, percent=80):
    sets = plain_sets(data, size)
    group = list(range(len(data)))
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= percent * (len(x) + len(sets[j]) - common) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: min((data[k][0] for k in range(len(data)) if group[k] == g and data[k][0] is not None), default=None) for g in set(group)}
    return sorted((str(i), len(s), str(ids[g]), i == ids[g]) for (i, _), s, g in zip(data, sets, group, strict=True))


def got_components(df, size):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minmax.near_duplicates(df, size).collect())


@pytest.mark.parametrize("size", [2, 5])
def test_components_of_odd_rows(odd, no_docs, size):
    assert got_components(odd, size) == plain_components([r[:2] for r in rows()], size)
    assert minmax.near_duplicates(no_docs, size).count() == 0


def near_group(n):
    """Copies of one text with more and more changed words: chains, links and outliers in the same buckets."""
    base, rng, data = invented(9, 100).split(), random.Random(5), []
    for k in range(n):
        words = list(base)
        for j in rng.sample(range(100), rng.choice([1, 3, 6, 12, 25])):
            words[j] = f"w{k}x{j}"
        data.append((1000 - k, " ".join(words)))
    return data + [(5000 + k, data[0][1]) for k in range(200)] + [(9000 + k, invented(100 + k, 40)) for k in range(60)]


@pytest.mark.parametrize("n", [30, 240])
def test_large_groups_lose_no_link(spark, n, monkeypatch):
    monkeypatch.setattr(minmax, "SMALL", 20)
    monkeypatch.setattr(minmax, "BLOCK", 16)
    data = near_group(n)
    assert got_components(spark.createDataFrame(data, "doc_id long, text string"), 2) == plain_components(data, 2)


def test_no_plan_holds_the_steps_before_it_again(spark, monkeypatch):
    exchanges = []

    def planned(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return df

    for module in ("minmax", "components"):
        monkeypatch.setattr(f"stewardry.llm.{module}.cut", lambda df, label="cut": scale.cut(planned(df), label))
    planned(minmax.near_duplicates(spark.createDataFrame(near_group(30), "doc_id long, text string"), 2))
    assert len(exchanges) > 10 and max(exchanges) <= 10


def test_one_row_of_each_group_stays(odd):
    got = minmax.clean(odd)
    assert got.columns == odd.columns
    ids = Counter(str(r.doc_id) for r in got.collect())
    # 2, 3 and the null id go with 1, one of the equal rows 12, of 7 and 8 and of 16 to 18 stays, rows without words stay
    assert ids == Counter(map(str, [1, 4, 5, 6, None, 7, 9, 10, 11, 12, 13, 14, 15, 16]))


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(data, width):
    texts = [(t or "").encode().split() for _, t in data]
    seen = Counter(tuple(w[p : p + width]) for w in texts for p in range(len(w) - width + 1))
    out = []
    for (i, _), words in zip(data, texts, strict=True):
        gone = {p + k for p in range(len(words) - width + 1) if seen[tuple(words[p : p + width])] > 1 for k in range(width)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_removed(df, width):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in debruijn.remove(df, width).collect())


@pytest.mark.parametrize("width", [35, 71, 72, 150])
def test_wide_windows_over_branching_paths(spark, width):
    rng = random.Random(3)
    stretches = [invented(700 + k, rng.randint(width - 20, width + 60)) for k in range(6)]
    data = [
        (k, " ".join([invented(900 + k, rng.randint(0, 9)), rng.choice(stretches), rng.choice(["x", "y z", ""]), rng.choice(stretches), invented(1100 + k, 5)]))
        for k in range(180)
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert got_removed(df, width) == plain_removed(data, width)


@pytest.mark.parametrize("width", [10, 35])
def test_repeated_windows_of_odd_rows(odd, no_docs, width):
    assert got_removed(odd, width) == plain_removed([r[:2] for r in rows()], width)
    assert debruijn.remove(no_docs, width).count() == 0


def test_repeated_windows_of_mixed_passages(spark):
    rng = random.Random(3)
    passages = [invented(50 + k, n).split() for k, n in enumerate((34, 35, 36, 60, 200))] + [["x"] * 50, ["x", "y"] * 40]
    data = [(k, " ".join(w for p in rng.sample(passages, 3) for w in p[rng.randint(0, 6):] + invented(700 + k, rng.randint(0, 9)).split())) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got_removed(df, 35) == plain_removed(data, 35)
    spans = debruijn.remove(df, 35).where("n_removed > 0").first()
    assert sum(s.end - s.start for s in spans.spans) == spans.n_removed


def test_stretches_change_no_hash(monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in rows()] + [b"", b"x" * 5000, b"a\tb\nc"]
    whole, counts = debruijn.hash_texts(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    words = {w for t in texts for w in t.split()}
    assert len(set(whole.tolist())) == len(words)
    monkeypatch.setattr(debruijn, "STRETCH", 40)
    again, same = debruijn.hash_texts(texts)
    assert again.tolist() == whole.tolist() and same.tolist() == counts.tolist()
    monkeypatch.setattr(common, "STRETCH", 40)
    assert [k for s in common.stretches(texts) for k in range(len(texts))[s]] == list(range(len(texts)))
    assert debruijn.hash_texts([])[1].tolist() == [] and minmax.shingle_sets([], 2) == []
