"""Operators whose work must not grow with what they need not look at: brute force, and sizes of what they make."""

import datetime
import functools
import itertools
import operator
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stewardry.functions import network, text
from stewardry.operators import checks, corpus, graph, joins, windows
from stewardry.sources import sinks
from stewardry.streaming import changes


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- numbers from a pool ------------------------------------------------------------------------------


def plain_allocation(asks, pools, used):
    out = []
    for pool in {p for p, _ in asks}:
        held = {}
        for p, number, who in used:
            if p == pool and who is not None:
                held[who] = min(number, held.get(who, number))
        taken = {n for p, n, _ in used if p == pool}
        free = (n for p, low, high in sorted(pools) if p == pool for n in range(low, high + 1) if n not in taken)
        for who in sorted({w for p, w in asks if p == pool}):
            if who in held:
                out.append((pool, who, held[who], "kept"))
            else:
                number = next(free, None)
                out.append((pool, who, number, "exhausted" if number is None else "allocated"))
    return sorted(out, key=str)


def test_allocation_against_brute_force(spark):
    rng = random.Random(1)
    pools = [("a", 0, 40), ("b", 5, 5), ("c", 100, 3000), ("d", 7, 6), ("e", 10, 20), ("e", 40, 45)]
    used = [(rng.choice("abce"), rng.randint(0, 60), rng.choice([None, None, *range(30)])) for _ in range(150)]
    asks = [(rng.choice("abcde"), rng.randint(0, 60)) for _ in range(300)]
    got = windows.allocate_next(
        spark.createDataFrame(asks, "pool string, r long"), spark.createDataFrame(pools, "pool string, low long, high long"),
        spark.createDataFrame(used, "pool string, number long, r long"), requester="r", block=8,
    )
    assert rows_of(got.select("pool", "r", "number", "status")) == plain_allocation(asks, pools, used)


def test_huge_pools_are_never_listed(spark):
    low, high = 10 << 24, (11 << 24) * 1_000_000
    pools = spark.createDataFrame([(1, low, high)], "pool long, low long, high long")
    used = spark.createDataFrame([(1, low + k, None) for k in (0, 1, 3, 5_000_000_000)], "pool long, number long, r long")
    asks = spark.createDataFrame([(1, k) for k in range(10)], "pool long, r long")
    started = time.time()
    got = rows_of(windows.allocate_next(asks, pools, used, requester="r").select("r", "number"))
    assert got == [(0, low + 2)] + [(k, low + 3 + k) for k in range(1, 10)]
    assert time.time() - started < 60


# --- intervals ----------------------------------------------------------------------------------------


def test_blocks_of_an_interval(spark):
    spans = [(a, b) for a in range(-9, 10) for b in range(a + 1, a + 20)] + [(-(10**12), 10**12 + 7), (3, 3 + 2**40)]
    found = defaultdict(list)
    for r in joins._power_blocks(spark.createDataFrame(spans, "a long, b long"), F.col("a"), F.col("b")).collect():
        found[r.a, r.b].append((r["block"] << r["size"], (r["block"] + 1) << r["size"]))
    assert sorted(found) == sorted(spans)
    for (a, b), runs in found.items():
        runs.sort()
        assert runs[0][0] == a and runs[-1][1] == b and all(x[1] == y[0] for x, y in zip(runs, runs[1:], strict=False))
        assert len(runs) <= 2 * (b - a).bit_length()


# --- best known issues --------------------------------------------------------------------------------


def plain_best(subjects, issues, k, least, stop=()):
    tokens = {i: {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if w not in stop} for i, t in issues}
    df = Counter(w for words in tokens.values() for w in words)
    out = []
    for s, text in subjects:
        words = set("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
        scored = [(-sum(max(1, 10**9 // df[w]) for w in words & t), i, len(words & t)) for i, t in tokens.items() if words & t]
        out += [(s, i, n, -score, r) for r, (score, i, n) in enumerate(sorted(x for x in scored if -x[0] >= least)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("rare", "least"), [(1, 1), (3, 1), (16, 1), (2, 300_000_000), (1000, 1)])
def test_best_issues_against_brute_force(spark, rare, least):
    rng = random.Random(rare)
    words = [f"w{k}" for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]  # a few words are on almost all issues
    texts = lambda n: [(k, " ".join(rng.choices(words, weight, k=rng.randint(0, 12)))) for k in range(n)]
    subjects, issues = texts(80), texts(60)
    subjects += [(100, None), (101, ""), (102, "w0 w1"), (103, "w0"), *[(k, subjects[0][1]) for k in range(200, 220)]]
    issues += [(100, None), (101, "W0, w0!"), (102, "w59")]
    got = corpus.top_known_issues(
        spark.createDataFrame(subjects, "s long, text string"), spark.createDataFrame(issues, "i long, note string"), 3,
        subject="s", subject_text="text", issue="i", issue_text="note", min_score=least, rare=rare, widen=3,
    )
    assert rows_of(got.select("s", "i", "n_shared", "score", "rank")) == plain_best(subjects, issues, 3, least)


def test_hot_words_are_not_joined(spark, monkeypatch):
    """Words that all subjects and issues share make no pair: pairs grow with the rare words."""
    met = []

    def watched(df, label="cut", cut=corpus.cut):
        out = cut(df, label)
        if label == "met":
            met.append(out)
        return out

    monkeypatch.setattr(corpus, "cut", watched)
    for n in (100, 400):
        met.clear()
        texts = spark.range(n).select("id", F.concat(F.lit("common word here own"), F.col("id")).alias("t"))
        found = corpus.top_known_issues(
            texts, texts.select(F.col("id").alias("i"), F.col("t").alias("u")), 1, subject="id", subject_text="t", issue="i", issue_text="u", rare=16,
        ).collect()
        assert sorted((r.id, r.i, r.n_shared) for r in found) == [(k, k, 4) for k in range(n)]
        assert sum(x.count() for x in met) == n


# --- streams ------------------------------------------------------------------------------------------


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    deliveries = [[0, 1, 30], [2, 31, 200], [3, 150, 400, None]]
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, user_id long"

    def deliver(minutes):
        rows = [(None if m is None else base + datetime.timedelta(minutes=m), 1) for m in minutes]
        spark.createDataFrame([*rows, (base, None)], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        feed = changes.change_feed(spark, folder, spark.createDataFrame([], schema).schema)
        return changes.stream_incidents(feed, ["user_id"], "ts", gap_seconds=1800, delay="10 minutes", root=root)

    def minutes(df, *columns):
        return sorted(tuple((r[c] - base).total_seconds() / 60 for c in columns) for r in df.collect())

    for k, part in enumerate(deliveries):
        deliver(part)
        out = run()
        if k == 1:  # the last batch is taken as not committed and runs again
            (tmp_path / "out" / "checkpoint" / "commits" / "1").unlink()
            (tmp_path / "out" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
            out = run()
            assert minutes(out.final, "first_seen", "last_seen") == [(0, 31)] and minutes(out.held, "first_seen", "last_seen") == [(200, 200)]
    assert minutes(out.final, "first_seen", "last_seen") == [(0, 31), (200, 200)]
    assert minutes(out.held, "first_seen", "last_seen") == [(400, 400)]
    assert minutes(out.late, "ts") == [(3,), (150,)]
    assert sum(r.n_signals for r in out.final.collect()) == 6


# --- rules as rows ------------------------------------------------------------------------------------


def test_a_thousand_rules_in_one_plan(spark):
    rng = random.Random(8)
    alphabet = ["on", "er", "Ü", "data", " ", "the  end", "x-1", "1.2", "!", "é"]
    texts = [(k, "".join(rng.choices(alphabet, k=rng.randint(0, 25)))) for k in range(40)] + [(98, None), (99, "")]
    rules, modes = [], {}
    for k in range(1000):
        modes[f"r{k}"] = rng.choice(["require_all", "require_any", "forbid"])
        for _ in range(rng.randint(1, 3)):
            rules.append((f"r{k}", modes[f"r{k}"], "phrase", "".join(rng.choices(alphabet, k=rng.randint(1, 3)))))
    rules.append(("p", "forbid", "pattern", r"\d\.\d"))
    modes["p"] = "forbid"
    got = corpus.text_rule_rows(
        spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(rules, "rule string, mode string, kind string, term string")
    ).collect()
    low = {i: re.sub(r"\s+", " ", (t or "").lower()) for i, t in texts}
    terms = defaultdict(set)
    for rule, _, kind, term in rules:
        terms[rule].add((kind, re.sub(r"\s+", " ", term.lower()) if kind == "phrase" else term))
    for r in got:
        hits = [re.search(t, low[r.id]) is not None if kind == "pattern" else t in low[r.id] for kind, t in terms[r.rule]]
        assert r.passed == {"require_all": all(hits), "require_any": any(hits), "forbid": not any(hits)}[modes[r.rule]], (r, low[r.id], terms[r.rule])
    assert len(got) == len(texts) * 1001


def test_rules_that_cannot_be_read_are_refused(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    for bad in [("r", "perhaps", "phrase", "a"), ("r", "forbid", "word", "a"), ("r", "forbid", "phrase", None)]:
        with pytest.raises(checks.GateClosed, match="rule=r"):
            corpus.text_rule_rows(texts, "id", "text", spark.createDataFrame([bad], "rule string, mode string, kind string, term string"))


# --- shapes -------------------------------------------------------------------------------------------


def test_shape_candidates_grow_no_faster_than_shapes(spark, monkeypatch):
    counts = []
    real = corpus.cut

    def watched(df, label="cut"):
        out = real(df, label)
        if label == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(corpus, "cut", watched)
    for n in (300, 3000):
        rng = random.Random(n)
        rows = [(k, f"a{a}") for k in range(n) for a in {*(int(rng.random() ** 2 * n) for _ in range(8)), 0, 1}]
        corpus.shape_duplicates(spark.createDataFrame(rows, "node long, attribute string"), "node", "attribute").count()
    assert counts[1] <= 30 * max(counts[0], 20)  # ten times the shapes; all pairs would be a hundred times as many


def test_shapes_meet_on_as_many_attributes_as_they_must_share(spark):
    codes = [3, 5, 9, 17, 33, 65]
    for k in range(1, 7):
        (found,) = spark.range(1).select(corpus._combinations(F.array(*[F.lit(c).cast("bigint") for c in codes]), F.lit(k))).first()
        assert sorted(found) == sorted(functools.reduce(operator.xor, c) for c in itertools.combinations(codes, k))


def test_dense_shapes_against_brute_force(spark):
    rng = random.Random(5)
    shapes = {i: frozenset(rng.sample(range(13), rng.randint(1, 11))) for i in range(400)}
    rows = [(i, f"a{x}") for i, s in shapes.items() for x in s]
    first = {}
    for i, s in shapes.items():
        first.setdefault(s, i)
    for percent in (50, 70, 85):
        out = corpus.shape_duplicates(spark.createDataFrame(rows, "node long, attr string"), "node", "attr", percent=percent)
        alike = {s: sum(len(s & o) * 100 > len(s | o) * percent for o in shapes.values()) for s in first}
        assert rows_of(out.select("shape", "n_alike")) == sorted(((first[s], n) for s, n in alike.items() if n >= 3), key=str)


# --- addresses, files, cycles, numbers ----------------------------------------------------------------


def test_addresses_of_both_families(spark):
    import ipaddress

    rng = random.Random(6)
    given = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "fe80::1:2", "::ffff:10.0.0.1", "1:2:3:4:5:6:7.8.9.10", "2001:DB8::A", "255.255.255.255", "0.0.0.0"]
    given += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(40)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(20)]
    bad = ["", ":", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":1::2", "1::2:", "g::", "1.2.3", "1.2.3.256", "::1.2.3.4.5", "1/2/3", "::/129", "1.2.3.4/33", "::/x"]
    rows = spark.createDataFrame([(a,) for a in [*given, *bad]], "a string").select("a", network.ip_parts(F.col("a")).alias("p")).collect()
    for r in rows:
        if r.a in bad:
            assert r.p is None, r.a
        else:
            ip = ipaddress.ip_address(r.a)
            number = (r.p.hi % 2**64) << 64 | r.p.lo % 2**64
            assert (r.p.family, number, r.p.length) == (ip.version, int(ip), 128), r.a
    prefixes = [f"{a}/{rng.randint(0, 128 if ':' in a else 32)}" for a in given]
    df = spark.createDataFrame([(p,) for p in prefixes], "prefix string").select("prefix", F.lit(1).alias("site"))
    ips = spark.createDataFrame([(a, 1) for a in given], "ip string, site int")
    nets = [ipaddress.ip_network(p, strict=False) for p in prefixes]
    best = {r.ip: r.best_prefix for r in joins.longest_prefix(ips, df, address="ip", scope="site").collect()}
    for a in given:
        inside = [n for n in nets if n.version == ipaddress.ip_address(a).version and ipaddress.ip_address(a) in n]
        want = max((n.prefixlen for n in inside), default=None)
        assert (best[a] and int(best[a].split("/")[1])) == want
    outside = {r.ip for r in joins.cidr_containment(ips, df, address="ip", scope="site").collect()}
    assert outside == {a for a in given if best[a] is None}


def test_digests_of_files(spark, tmp_path):
    import hashlib

    rng = random.Random(9)
    contents = [b"", b"\n", b"a", b"a\n", b"\n\n\r\n", rng.randbytes(50_000), b"x" * 300_000 + b"\n", "é\n".encode("latin-1") * 999]
    for k, content in enumerate(contents):
        (tmp_path / f"f{k}.bin").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = {r["_path"].rsplit("/", 1)[-1]: (r["sha256"], r["bytes"]) for r in sinks.file_digests(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"f{k}.bin": (hashlib.sha256(c).hexdigest(), len(c)) for k, c in enumerate(contents) if c}


def test_cycles_by_name(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "f"), ("h", "h"), ("d", "i"), ("j", "k"), ("x", "missing")]
    links += [(f"n{k:02}", f"n{(k + 1) % 20:02}") for k in range(20)] + [("a", "n00")]
    nodes = sorted({x for pair in links for x in pair} - {"missing"})
    got = graph.dependency_cycles(
        spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(links, "src string, dst string")
    ).collect()
    want = {**dict.fromkeys("abc", ("cycle", "a")), **dict.fromkeys("de", ("cycle", "d")), "f": ("behind", None), "g": ("behind", None), "h": ("cycle", "h")}
    want |= {f"n{k:02}": ("cycle", "n00") for k in range(20)}
    assert {r.node: (r.status, r.cycle) for r in got} == want
    assert graph.dependency_cycles(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_long_numbers_fold(spark):
    from stewardry.functions.text import expand_range

    names = [f"sn{123456789012345678901 + k}" for k in range(6)] + [f"sn{10**18 + k}" for k in range(5)] + ["sn7", "sn8", f"t{9 * 10**40}"]
    df = spark.createDataFrame([("p", n, "r") for n in names], "parent string, name string, role string")
    folded = windows.collapse_ranges(df, "parent", "name", ["role"])
    assert {r.name for r in folded.where("expand_range").collect()} == {"sn123[456789012345678901-456789012345678906]", "sn1[000000000000000000-000000000000000004]"}
    assert sorted(r.name for r in expand_range(folded, "name").collect()) == sorted(names)


# --- small functions ----------------------------------------------------------------------------------


def test_modules_and_files_are_no_hosts(spark):
    lines = {
        "app.core.schema_gone: x": "app.core.schema_gone: x", "job.py failed": "job.py failed", "no route to db-1.prod.internal": "no route to <host>",
        "db.prod.zone7:5432 refused": "<host>:<n> refused", "www.example.com gave 502": "<host> gave <n>",
    }
    df = spark.createDataFrame([(k,) for k in lines], "m string").select("m", text.error_template(F.col("m")).alias("t"))
    assert {r.m: r.t for r in df.collect()} == lines


def test_artifact_forms(spark, tmp_path):
    df = spark.createDataFrame([("t", 'a,"b"\nc', 1), ("t", "plain", 2)], "target string, name string, n int")
    content = F.struct("name", "n")
    sinks.write_artifacts(df, "target", content, "text/csv", str(tmp_path / "csv"))
    [path] = (tmp_path / "csv" / "target=t").glob("*.csv")
    import csv

    assert list(csv.reader(path.open(newline=""))) == [["name", "n"], ['a,"b"\nc', "1"], ["plain", "2"]]
    with pytest.raises(ValueError, match="needs text"):
        sinks.write_artifacts(df, "target", content, "text/markdown", str(tmp_path / "md"))
    sinks.write_artifacts(df, "target", F.col("name"), "text/markdown", str(tmp_path / "md"))


# --- long chains --------------------------------------------------------------------------------------


def plain_levels(seeds, links):
    level, frontier, k = dict.fromkeys(seeds, 0), list(seeds), 0
    after = defaultdict(list)
    for a, b in links:
        after[a].append(b)
    while frontier:
        k += 1
        frontier = list({b for a in frontier for b in after[a] if b not in level})
        level.update(dict.fromkeys(frontier, k))
    return level


def plain_depths(nodes, refs):
    below = {n: {b for a, b in refs if a == n and b in nodes} for n in nodes}
    out = {}
    while True:
        ready = [n for n in nodes if n not in out and all(b in out for b in below[n])]
        if not ready:
            return {n: out.get(n) for n in nodes}
        out.update({n: 1 + max((out[b] for b in below[n]), default=-1) for n in ready})


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(60)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range((40, 70, 60, 90)[seed])] + [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("n1", "c0"), ("c30", "n2"), ("c9", "n3")]
    links += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), (None, "n1"), ("n1", None)]
    edges = spark.createDataFrame(links, "src string, dst string")
    seeds = ["n1", "n5", "c12"]
    got = graph.reachable(spark.createDataFrame([(s,) for s in seeds], "node string"), edges).collect()
    want = plain_levels(seeds, [x for x in links if None not in x])
    assert {r.node: r.level for r in got} == want and len(got) == len(want)
    near = graph.reachable(spark.createDataFrame([(s,) for s in seeds], "node string"), edges, max_depth=3).collect()
    assert {r.node: r.level for r in near} == {n: k for n, k in want.items() if k <= 3}
    acyclic = [(a, b) for a, b in links if a and b and (a < b or seed % 2)]
    known = sorted({x for pair in acyclic for x in pair} - {"n7"})
    depths = graph.dependency_levels(spark.createDataFrame([(n,) for n in known], "node string"), spark.createDataFrame(acyclic, "src string, dst string")).collect()
    assert {r.node: r.level for r in depths} == plain_depths(set(known), acyclic) and len(depths) == len(known)


def test_a_chain_of_a_hundred_thousand(spark, monkeypatch):
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, label="cut": cuts.append(label) or real(df, label))
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.reachable(spark.createDataFrame([(0,)], "node long"), chain)
    assert got.agg(F.count("*"), F.max("level"), F.sum((F.col("node") != F.col("level")).cast("int"))).first() == (n + 1, n, 0)
    levels = graph.dependency_levels(spark.range(n + 1).select(F.col("id").alias("node")), chain)
    assert levels.agg(F.max("level"), F.sum((F.col("node") + F.col("level") != n).cast("int"))).first() == (n, 0)
    assert len(cuts) < 80
