"""Packing, toxicity, decontamination and the n-gram model against brute force."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from stewardry.llm import decontam, kneser_ney, packing, queries, toxicity
from tests.llm.conftest import invented, rows

# packing ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [1024, 64])
def test_every_token_lies_in_one_gapless_piece(odd, length):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    own.encode_special_tokens = True
    got = packing.pack(odd, queries.tokenizer_path(), length).collect()
    want = collections.Counter()
    for i, text, *_ in rows():
        want[(i, tuple(own.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    for (i, n), pieces in documents.items():
        copies = sum(c for (j, ids), c in want.items() if (j, len(ids)) == (i, n))
        assert sum(len(x) for _, x in pieces) == copies * n
        by_start = collections.defaultdict(set)
        for start, ids in pieces:
            by_start[start].add(tuple(ids))
        for (j, ids) in want:
            if (j, len(ids)) == (i, n) and sum((k, len(x)) == (i, n) for k, x in want) == 1:
                assert all(tuple(ids[s : s + len(x)]) == x for s, found in by_start.items() for x in found)
    assert sum(want.values()) == sum(1 for r in got if r.start == 0)


def test_no_documents_give_no_pieces(no_docs):
    assert packing.pack(no_docs, queries.tokenizer_path()).count() == 0


def test_fast_tokenizer_gives_the_ids_of_the_file():
    tokenizer = packing.Tokenizer(queries.tokenizer_path())
    assert tokenizer.fast is not None
    parts = [" ", "  ", "\n", "\t", " ", "a", "bc", "'s", "don't", "1", "22", "é", "日本", "!", "\r", "<|endoftext|>", "\x1c", "\x85", "_", "😀", "the", "ing"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 24))) for _ in range(4000)] + ["a" * 5000, " " * 5000]
    for text, encoding in zip(texts, tokenizer.own.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert tokenizer.encode(text).tolist() == encoding.ids


@pytest.mark.parametrize("blanks", [" ", "\n", " \t\u3000\n"])
def test_very_long_runs_of_blanks(spark, blanks):
    from tokenizers import Tokenizer

    text = "word" + blanks * (2_000_000 // len(blanks)) + "word"
    docs = spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string")
    pieces = packing.pack(docs, queries.tokenizer_path()).where("doc_id = 1").orderBy("start").collect()
    own = Tokenizer.from_file(queries.tokenizer_path())
    want = own.encode(text, add_special_tokens=False).ids + [0]
    assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == want


def test_added_tokens_keep_their_ids(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    import corpus_pipeline

    own = Tokenizer.from_file(queries.tokenizer_path())  # as the file says
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f"x{mark}", f"{mark}\n\n y", "<|endoftext", "plain text", "", None]
    assert own.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {k: own.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(packing, "with_checksum", lambda pieces: pieces)
    for got in (queries.op3(spark, str(tmp_path)), corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        found = collections.defaultdict(list)
        for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.start)):
            assert r.doc_tokens == len(want[r.doc_id])
            found[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert found == want


def test_hilbert_curve_visits_each_cell_and_moves_one_step():
    points = np.array(list(itertools.product(range(4), repeat=3)))
    keys = packing.hilbert(points, 2)
    assert sorted(keys.tolist()) == list(range(64))
    walked = points[np.argsort(keys)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_have_near_keys():
    a, b, c = (packing.curve_keys([np.array(x)])[0] for x in ([1, 2, 3] * 50, [1, 2, 3] * 50 + [4], [900, 901, 17] * 50))
    assert abs(int(a) - int(b)) <= abs(int(a) - int(c))


# toxicity -----------------------------------------------------------------------------------------------------------


def plain_segments(values):
    """Maximal scoring segments by their definition: best first, then left and right of it."""
    if not values:
        return []
    best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
    total, _, _, i, j = best
    if total <= 0:
        return []
    return [*plain_segments(values[:i]), total, *plain_segments(values[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(8)
    for _ in range(200):
        gaps = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        scores = [rng.choice([1.25, 2.75, 4.1]) for _ in gaps]
        values = [v for s, g in zip(scores, gaps, strict=True) for v in [toxicity.PENALTY] * g + [s]]
        got = [s for s, _, _ in toxicity.maximal_segments(scores, gaps)]
        assert sorted(got) == pytest.approx(sorted(plain_segments(values)))


def test_toxic_words_are_learned(spark, odd, no_docs):
    bad = ["grumblefop", "snarkwit", "vilebrag"]
    rng = random.Random(2)

    def text(k):
        words = invented(2000 + k, 80).split()
        if k % 5 == 0:
            for j in rng.sample(range(80), 3):
                words[j] = rng.choice(bad)
        return " ".join(words)

    docs = spark.createDataFrame([(k, text(k)) for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in got if r.doc_id >= 300)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, model).drop("score", "passages").columns == [c for c in odd.columns if c != "score"]
    assert toxicity.score(no_docs, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}


# decontamination ----------------------------------------------------------------------------------------------------

ITEMS = [(1, invented(70, 30)), (2, invented(71, 14)), (3, None), (4, "too short"), (5, invented(72, 50)), (6, invented(70, 30))]


def plain_matches(data, items=None):
    def grams(words):
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

    out = {}
    for i, text in data:
        words = (text or "").lower().split()
        for item, item_text in items or ITEMS:
            own = (item_text or "").lower().split()
            if len(own) < 5:
                continue
            target = collections.Counter(grams(own))
            for p in range(max(1, len(words) - len(own) + 1)):
                window = collections.Counter(grams(words[p : p + len(own)]))
                common = sum((window & target).values())
                union = sum(window.values()) + sum(target.values()) - common
                if 100 * common >= 80 * union:
                    out[i, item] = max(out.get((i, item), 0), common / union)
    return out


@pytest.mark.parametrize("block", [20_000, 2])
def test_matches_of_planted_items(spark, odd, no_docs, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    data, rng = [], random.Random(4)
    for k in range(120):
        words = rng.choice([ITEMS[0], ITEMS[1], ITEMS[4]])[1].split()
        lost = rng.choice([0, 0, 1, 2, 3, 6])
        words = words[lost:] if k % 2 else words[: len(words) - lost]
        if k % 7 == 0:
            words[rng.randrange(len(words))] = "other"
        around = [invented(300 + k, rng.choice([0, 20])), invented(600 + k, rng.choice([0, 20]))]
        data.append((k, f"{around[0]} {' '.join(words).upper() if k % 3 else ' '.join(words)}\n{around[1]}"))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_matches(data)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs, items).collect()}
    assert got == pytest.approx(want) and len(want) > 50
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {i for i, _ in data} - {i for i, _ in want}
    assert decontam.clean(odd, items).count() == len(rows()) and decontam.clean(odd, items).columns == odd.columns
    assert decontam.clean(no_docs, items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("run", [4096, 3])
def test_blocks_are_simhashes_of_each_windows_groups(run, monkeypatch):
    monkeypatch.setattr(decontam, "RUN", run)
    values = np.random.default_rng(1).integers(0, 1 << 63, 60_000).astype(np.uint64)
    first = np.array([*range(0, 90), 97, *range(400, 420), *range(30_000, 39_000), 59_950])
    parts = list(decontam.runs(first, 50))
    assert np.concatenate(parts).tolist() == first.tolist() and all(p[-1] - p[0] <= max(run, 50) for p in parts)
    for part in (parts[0], parts[-1]):
        keys = collections.defaultdict(set)
        for some, key in decontam.block_keys(values[part[0] : part[-1] + 50], part - part[0], 50, 54, 17):
            for k, x in zip(some.tolist(), key.tolist(), strict=True):
                keys[int(part[k])].add(x)
        for p in part.tolist():  # a window by itself has the same blocks
            alone = {x for _, key in decontam.block_keys(values[p : p + 50], np.zeros(1, dtype=np.int64), 50, 54, 17) for x in key.tolist()}
            assert keys[p] == alone and 0 < len(alone) <= 17


def test_all_within_the_radius_share_a_block_and_others_none():
    rng = np.random.default_rng(5)
    for n in (1, 4, 9, 30, 60, 200):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n + 4)) for _ in range(40)]
        index = decontam.Index(list(enumerate(texts)))
        assert not len(index.few[n + 4])
        for k in range(40):
            own = index.shingles[index.offsets[k] : index.offsets[k + 1]].copy()
            rng.shuffle(own)
            lost = decontam.radius(n) // 2  # as many go as come
            own[:lost] = rng.integers(0, 1 << 63, lost).astype(np.uint64)
            keys = np.concatenate([key for _, key in decontam.block_keys(own, np.zeros(1, dtype=np.int64), n, n + 4, index.n_blocks[n + 4])])
            met = index.by_block.find(keys)[1].tolist()
            assert set(met) == {k} and len(met) >= index.needed[k] >= 1


def test_candidates_of_a_common_phrase_are_few():
    """All items share a phrase with all texts; only the window that is an item has a candidate."""
    phrase = "this is a phrase that all of them share with each other"
    items = [(k, f"{invented(1000 + k, 12)} {phrase} {invented(2000 + k, 12)}") for k in range(300)]
    index = decontam.Index(items)
    windows = met = 0
    for k in range(50):
        words, _ = decontam.hash_texts([f"{invented(5000 + k, 40)} {phrase} {invented(6000 + k, 40)}".encode()])
        values = decontam.shingles(words)
        at = index.shared(values)
        windows += sum(len(first) for _, first in index.windows(values, len(words), at))
        met += sum(len(found) for *_, found in index.candidates(values, len(words), at))
        assert index.search(values, len(words), at) == {}
    assert windows >= 500 and met <= windows / 10  # of 300 items that each window could meet
    [found] = decontam._matches(index, [items[7][1]])
    assert list(found) == [7]


def test_items_of_few_shingles_are_found(spark):
    items = [(1, "ab " * 60), (2, "x y " * 40), (3, "la la la la la")]
    data = [(1, "start " + "ab " * 57), (2, "y x " * 39 + "z"), (3, "la " * 5), (4, "la " * 9), (5, "ab " * 300)]
    got = decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    monkey = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert monkey == pytest.approx(plain_matches(data, items))


def test_a_long_text_with_an_item_near_each_end_is_searched_in_stretches(monkeypatch):
    sizes, signs = [], decontam.signs
    index = decontam.Index([(1, ITEMS[0][1])])
    monkeypatch.setattr(decontam, "signs", lambda v: (sizes.append(len(v)), signs(v))[1])
    filling = invented(80, 30_000)
    [found] = decontam._matches(index, [f"{ITEMS[0][1]} {filling} {ITEMS[0][1]}"])
    assert found == {0: (1.0, 0, 30)} and sum(sizes) < 1000


# n-gram model -------------------------------------------------------------------------------------------------------


def plain_model(texts):
    counts = {4: collections.Counter(s[i - 3 : i + 1] for s in texts for i in range(3, len(s)))}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    types, orders = len(counts[1]), {}
    for n, grams in counts.items():
        of = collections.Counter(min(c, 5) for c in grams.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else None
        d = [0.0] + [min(k - 0.1, max(0.1, k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] and of[k + 1] else 0.5 * k)) for k in (1, 2, 3)]
        total, left = collections.Counter(), collections.Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        orders[n] = (grams, d, total, left)

    def p(g):
        if not g:
            return 1 / (types + 1)
        grams, d, total, left = orders[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = grams.get(g, 0)
        return (c - d[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_perplexity_by_both_ways(spark, odd, no_docs):
    docs = spark.createDataFrame([(k, invented(k, 30), "en") for k in range(60)] + [(99, "zq zq %% é", "en"), (98, None, "en"), (97, "x", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 5 and 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    texts = {r.doc_id: "   " + " ".join((r.text or "").lower().split()) for r in docs.collect()}
    p = plain_model([texts[k] for k in range(60) if k % 5])
    tables = kneser_ney.model(kneser_ney.count_grams(kneser_ney.trusted_rows(docs, labels, "quality")))
    for most in (4_000_000, 0):
        got = {r.doc_id: r.perplexity for r in kneser_ney.with_perplexity(docs, tables, most).collect()}
        assert got[98] is None and got[97] is None
        for k in [*range(60), 99]:
            s = texts[k]
            assert got[k] == pytest.approx(math.exp(-sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)))
    judged = kneser_ney.judge(docs, labels)
    rejected = {r.doc_id for r in judged.where("NOT kept").collect()}
    assert 99 in rejected and len(rejected) < 12 and not rejected & {97, 98}
    assert kneser_ney.judge(odd, labels).count() == len(rows()) and kneser_ney.judge(no_docs, labels).count() == 0
    assert kneser_ney.judge(odd, labels.limit(0)).where("NOT kept").count() == 0


def test_checksum_is_of_little_endian_ids():
    assert packing.checksum(np.array([1, 256])) == zlib.crc32(b"\x01\0\0\0\0\x01\0\0")
