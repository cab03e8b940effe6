"""Merkle manifest, prefix trie and language identification against brute force, held-out labels and odd rows."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from stewardry.llm import language, merkle, ordering, trie
from tests.llm.conftest import rows as odd_rows

# Merkle manifest ----------------------------------------------------------------------------------------------------


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_walk(levels, at, digest):
    proof = []
    for level in levels[:-1]:
        if (at ^ 1) < len(level):
            other = level[at ^ 1]
            proof.append(other)
            digest = h(digest + other) if at % 2 == 0 else h(other + digest)
        else:
            digest = h(digest)
        at //= 2
    return proof, digest


def plain_manifest(docs):
    """doc_id, leaf, subroot, root, digest of the proof, folded root, per row of (doc_id, source, lang, n_chars, text)."""
    def leaf(doc, more):
        cells = [doc[0], doc[1], doc[2], None if doc[3] is None else doc[3] + more, doc[4]]
        return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    by_lang = defaultdict(list)
    for doc in docs:
        changed = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 7 == 0
        by_lang[doc[2]].append((doc[0], leaf(doc, 0), leaf(doc, int(changed))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([x[1] for x in by_lang[lang]])
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (doc_id, digest, changed) in enumerate(by_lang[lang]):
            low, folded = plain_walk(trees[lang], at, changed)
            high, folded = plain_walk(top, k, folded)
            out.append((doc_id, digest, trees[lang][-1][0], top[-1][0], h("".join(low + high)), folded))
    return sorted(map(str, out))


def manifest_rows(docs):
    got = merkle.manifest(docs, language.held_out(F.col("doc_id"), 7, 0))
    return got.select("doc_id", *(merkle.hex_of(c) for c in ("leaf", "subroot", "root")), merkle.proof_digest(), merkle.hex_of("folded"))


def test_manifest_of_odd_rows(spark, odd, no_docs):
    docs = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    assert sorted(str(tuple(r)) for r in manifest_rows(odd).collect()) == plain_manifest(docs)
    assert manifest_rows(no_docs).collect() == []


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (255, 256, 257), (3, 1030)])
def test_manifest_over_blocks(spark, sizes):
    docs = [(i, "s", f"l{k}", 10 * i, f"text {i}") for k, n in enumerate(sizes) for i in range(k, n + k)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in manifest_rows(df).collect()) == plain_manifest(docs)


def test_manifest_of_three_rounds(spark):
    n = 66_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.lit("").alias("text"))
    got = manifest_rows(df)
    want = plain_manifest([(i, None, "x", 1, "") for i in range(n)])
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_manifest_of_many_languages_and_equal_rows(spark):
    docs = [(1, "s", f"l{i}", 1, "t") for i in range(300)] + [(7, "s", None, 1, "t")] * 300
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(str(tuple(r)) for r in manifest_rows(df).collect()) == plain_manifest(docs)


def test_versions_copy_ancestors_only(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    found = merkle.manifest(df, F.col("doc_id") == 5).collect()
    assert [r.doc_id for r in found if r.version] == [5]
    for r in found:
        assert (r.folded == r.root) == (r.doc_id != 5)
        if r.version:
            assert len(r.version) == len(r.path) == 9 and bytes(r.version[-1]) == bytes(r.folded)
            assert [bytes(x) for x in r.version] == merkle.ancestors(bytes.fromhex(h(f"{len('5')}:5" + "1:s1:x1:21:t")), [bytes(p) for p in r.path])


def test_positions_split_a_key(spark):
    n = 5000
    df = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") % 10).alias("o"), "id").repartition(7)
    got = ordering.positions(df, "key", ["o"], "t")
    rows = got.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(n)) and {r.n for r in rows} == {n}
    assert [r.o for r in rows] == sorted(r.o for r in rows)


# Prefix trie --------------------------------------------------------------------------------------------------------


def plain_trie(turn_rows):
    own = defaultdict(list)
    for conv, turn, role, text in turn_rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members = defaultdict(list)
    for c, mine in own.items():
        given = zlib.crc32(str(c).encode()) % 9
        rebuilt = own.get(c - int(np.fmod(c, 5)), [])[:given] + mine[given:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        members[tuple(rebuilt), "ends"].append(c)
    nodes = [k for k in members if not (len(k) == 2 and k[1] == "ends")]
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        below = children[k]
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        ends = ",".join(map(str, sorted(members.get((k, "ends"), []))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k], h(ends)))
    return sorted(map(str, out))


def trie_rows(df, bits=trie.STRETCH_BITS, shard=trie.SHARD_ROWS):
    conv = F.col("conv_id")
    members = trie.grafted(trie.turns(df), conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8, bits)
    found = trie.trie(members, bits, shard)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r)) for r in found.collect())


TURNS = "conv_id long, turn long, role string, text string, depth string, owner string"


def invented_turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -7, -3, 1000, 1003]:
        if c % 10 == 5:
            continue  # their followers have no base
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", None, "ä"]), rng.choice(["hi", "hi", "ho é", "", None]), "x", "y"))
    rows += [(61, None, "user", "first", "x", "y"), (61, 0, "user", "second", "x", "y"), (None, 0, "user", "lost", "x", "y")]
    rows += [(62, 3, "user", "same", "x", "y")] * 4  # repeated rows, equal turns
    for c in (70, 71, 72):  # copies of a long conversation, and one that leaves it late
        rows += [(c, t, "user", f"t{t}" if (c, t) != (72, 40) else "other", "x", "y") for t in range(50)]
    return rows


@pytest.mark.parametrize(("bits", "shard"), [(trie.STRETCH_BITS, trie.SHARD_ROWS), (3, 20), (2, 1)])
def test_trie(spark, bits, shard):
    rows = invented_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    assert trie_rows(df, bits, shard) == plain_trie([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)) == []


def test_trie_of_a_long_and_a_hot_conversation(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(9000)] + [(c, t, "user", "same") for c in range(5, 2000, 5) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie_rows(df)
    # one chain of 9000 turns, less those that its missing base takes, and the copies on one path
    given = zlib.crc32(b"1") % 9
    assert len(got) == 1 + (9000 - given) + 3
    assert plain_root(rows) in got


def plain_root(rows):
    convs = {r[0] for r in rows}
    saved = sum(len(r[3]) for r in rows if r[0] != 1) - 3 * len("same")
    return str((1, 0, None, len(convs), 2, 2, saved, h("")))


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 40_000):
        first = rng.integers(0, 50, n, dtype=np.uint64)  # many equal halves
        second = np.arange(n, dtype=np.uint64)
        table = trie.PerfectHash(first, second)
        assert sorted(table.slots(first, second).tolist()) == list(range(n))
        assert (table.slots(first + np.uint64(100), second) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        trie.PerfectHash(np.ones(2, dtype=np.uint64), np.ones(2, dtype=np.uint64))


def test_accumulate_adds_subtrees():
    parents = np.array([-1, 0, 0, 1, 1, 4])
    assert trie.accumulate(np.array([1, 2, 3, 4, 5, 6]), parents, np.array([0, 1, 1, 2, 2, 3])).tolist() == [21, 17, 3, 4, 11, 6]


# Language identification --------------------------------------------------------------------------------------------


def test_subwords_of_pieces_add_up(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abÉ ,\n1x", k=500))
    whole = language.subwords(text)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(language, "PIECE", size)
        assert (language.subwords(text) == whole).all()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = [f" {w} "[i : i + n] for n in language.SIZES for w in words for i in range(len(w) + 3 - n)]
    assert whole.sum() == len(grams)
    assert language.subwords("").sum() == language.subwords(" 1, \n").sum() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 3, 1)
    model = language.learn(docs.where(~out))
    assert model.languages == ("de", "en", "es", "fr") and 1 <= model.temperature <= 20
    found = language.identify(docs.where(out), model).collect()
    right = [r.lang == r.lang_pred for r in found]
    assert len(found) > 250 and np.mean(right) >= 0.99
    assert np.mean([r.rejected for r in found]) < 0.05
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(spark, odd, no_docs):
    model = language.learn(odd)
    assert model.languages == ("de", "en")
    found = language.identify(odd, model)
    assert found.columns == [*(c for c in odd.columns if c != "score"), "lang_pred", "score", "rejected"]
    for r in found.collect():
        none = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    assert language.identify(no_docs, model).count() == 0
    nothing = language.learn(no_docs)
    assert {(r.lang_pred, r.score) for r in language.identify(odd, nothing).collect()} == {("und", 0.0)}
    alone = language.learn(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(odd, alone).collect()} == {"und", "en"}


def test_a_language_few_documents_have_is_learned(spark):
    rows = [("en", f"the cat and the dog number {w}") for w in "abcdefghij" * 20] + [("fi", "kissa ja koira ovat täällä")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language.learn(docs, most=100)
    assert model.judge("kissa on täällä")[0] == "fi" and model.judge("the dog and cat")[0] == "en"


def test_very_long_texts_have_a_language(spark):
    model = language.learn(spark.createDataFrame([("en", "the cat"), ("de", "die katze")], "lang string, text string"))
    assert model.judge("die katze " * 200_000)[0] == "de" and model.judge(" " * 2_000_000)[0] == "und"
