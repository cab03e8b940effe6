"""Bad and clean cases of the operators, round trips, and brute-force comparisons on small data."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry import scale
from stewardry.functions import coerce, network, text
from stewardry.operators import aggregates as agg
from stewardry.operators import checks, corpus, graph, joins, reconcile, windows
from stewardry.sources import delimited, documents, importing, sinks


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- checks -----------------------------------------------------------------------------------------


def test_device_names(spark):
    names = ["par01-spine-01", "lon02-leaf-03", "SPINE-01", "spine-01", "Leaf_03", "par01-leaf", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    bad = checks.regex_conformance(
        df, "name", r"^[a-z]{3}[0-9]{2}-[a-z]+-[0-9]{2}\z", policy="p", kind="device", object_id="id"
    )
    assert [r[0] for r in values(bad, "object_id")] == ["2", "3", "4", "5", "6"]


def test_membership_ignores_null_but_presence_reports_it(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", "y"), (4, " ", "y")], "id int, v string, site string")
    allowed = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "c")], "site string, ok string")
    common = dict(policy="p", kind="k", object_id="id")
    assert values(checks.membership(df, "v", allowed, allowed_column="ok", **common), "object_id") == [("4",)]
    scoped = checks.membership(df, "v", allowed, allowed_column="ok", scope="site", **common)
    assert values(scoped, "object_id") == [("3",), ("4",)]
    assert values(checks.presence(df, "v", **common), "object_id") == [("2",), ("4",)]


def test_unknown_filter_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    with pytest.raises(checks.UnknownFilter):
        checks.get_nodes(df, {"colour__value": "red"}, id_column="id")
    assert checks.get_nodes(df, {"ids": [1], "hfid": ["a"]}, id_column="id", hfid=["name"]).count() == 1


def test_gate_names_all_unmapped_columns(spark):
    headers = spark.createDataFrame([("d.csv", "name"), ("d.csv", "gpu_count")], "file string, column string")
    mapping = spark.createDataFrame([("name",)], "column string")
    missing = checks.unmapped_columns(headers, mapping)
    with pytest.raises(checks.GateClosed, match="1 unmapped columns: .*gpu_count"):
        checks.fail_closed(missing, "unmapped columns")
    checks.fail_closed(missing.where("false"), "unmapped columns")


def test_type_conformance(spark):
    docs = [
        {"is_managed": True, "gpu_count": 8, "at": "2024-01-15", "meta": {"a": 1}},
        {"is_managed": "Yes", "gpu_count": "8", "at": "01/15/2024", "meta": "{}"},
        {"gpu_count": True},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    bad = checks.type_conformance(
        df, "doc", {"is_managed": "Boolean", "gpu_count": "Number", "at": "DateTime", "meta": "JSON"},
        policy="p", kind="k", object_id="id",
    )
    assert values(bad.groupBy("object_id").count(), "object_id", "count") == [("1", 4), ("2", 1)]


# --- joins ------------------------------------------------------------------------------------------


def test_peer_edges(spark):
    edges = spark.createDataFrame(
        [("a", "b", "up"), ("b", "a", "up"), ("a", "c", "up"), ("a", "d", "up"), ("d", "a", "disabled"), ("e", "e", "up"), ("f", None, "up")],
        "l string, r string, s string",
    )
    assert values(joins.missing_reverse(edges, "l", "r"), "l", "r") == [("a", "c")]
    states = joins.reverse_state(edges, "l", "r", F.col("s") == "up")
    assert values(states, "l", "r", "state") == [("a", "c", "missing"), ("a", "d", "inactive")]


def test_rack_units(spark):
    rows = [
        (1, "r1", 1, 2, "front", False), (2, "r1", 3, 1, "front", False),  # touching
        (3, "r1", 10, 2, "front", False), (4, "r1", 11, 1, "rear", False),  # opposite faces
        (5, "r2", 5, 1, "front", True), (6, "r2", 5, None, "rear", False),  # one full depth
        (7, "r2", None, 1, "front", True), (8, None, 5, 1, "front", True),
        (9, "r3", 1, 500, "front", True), (10, "r3", 499, 3, "front", True),
    ]
    df = spark.createDataFrame(rows, "id int, rack string, u int, h int, face string, deep boolean")
    pairs = joins.interval_overlap(
        df, bucket="rack", start="u", length="h", row_id="id", bin_width=4,
        condition=F.col("deep_a") | F.col("deep_b") | (F.col("face_a") == F.col("face_b")), carry=["face", "deep"],
    )
    assert values(pairs, "id_low", "id_high") == [(5, 6), (9, 10)]


def test_interval_overlap_of_long_and_odd_lengths(spark):
    rows = [("k", 1, 0, 10**9), ("k", 2, 10**9 - 1, 5), ("k", 3, 10**9, 1), ("k", 4, -50, 51), ("k", 5, 7, -3), ("k", 6, 7, None), ("k", 7, -50, 0)]
    df = spark.createDataFrame(rows, "k string, id int, s long, h long")
    got = values(joins.interval_overlap(df, bucket="k", start="s", length="h", row_id="id", bin_width=30), "id_low", "id_high")
    spans = [(i, s, s + max(h or 1, 1)) for _, i, s, h in rows]
    assert got == [(i, j) for i, a, b in spans for j, c, d in spans if i < j and a < d and c < b]


def test_interval_overlap_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else "b", rng.randrange(300), rng.randrange(0, 25)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, s int, h int")
    got = values(joins.interval_overlap(df, bucket="k", start="s", length="h", row_id="id", bin_width=7), "id_low", "id_high")
    want = sorted(
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and a[1] == b[1] and a[2] < b[2] + (b[3] or 1) and b[2] < a[2] + (a[3] or 1)
    )
    assert got == want


def test_cidr(spark):
    ips = spark.createDataFrame([("d1", "par", "10.0.1.5/32"), ("d2", "par", "10.0.2.5"), ("d3", "lon", "10.0.1.5"), ("d4", "lon", "10.0.01.5")], "d string, site string, ip string")
    prefixes = spark.createDataFrame([("par", "10.0.1.0/24"), ("lon", "10.0.2.0/23")], "site string, prefix string")
    assert values(joins.cidr_containment(ips, prefixes, address="ip", scope="site"), "d") == [("d2",), ("d3",)]
    spread = ips.select(network.cidr_first(F.lit("10.1.2.3/20")), network.cidr_last(F.lit("10.1.2.3/20"))).first()
    assert tuple(spread) == (10 * 2**24 + 2**16, 10 * 2**24 + 2**16 + 4095)


def test_profiles(spark):
    objects = spark.createDataFrame([(1, None), (2, "mine"), (3, None)], "id int, mtu string")
    assigned = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (3, "x"), (3, "w")], "id int, profile_id string")
    profiles = spark.createDataFrame([("a", 500, "9000"), ("b", 1000, "1500"), ("w", 7, None), ("x", 9, "x"), ("y", 9, "y")], "profile_id string, priority int, mtu string")
    out = joins.resolve_profiles(objects, assigned, profiles, ["mtu"], object_id="id")
    assert values(out, "id", "mtu", "mtu_from_profile", "mtu_source") == [(1, "9000", True, "a"), (2, "mine", False, None), (3, "x", True, "x")]
    with pytest.raises(ValueError):
        joins.resolve_profiles(objects, assigned, profiles, ["mtu"], object_id="id", identity=["mtu"])


def test_dropdown_steps(spark):
    choices = spark.createDataFrame([("active", "Active"), ("maintenance", "Maintenance"), ("up", "On"), ("down", "on")], "name string, label string")
    cells = spark.createDataFrame([(v,) for v in ["Active", "ACTIVE", "active", "on", "On", "ON", "retired", None]], "v string")
    got = {r.value: (r.name, r.status) for r in joins.dropdown_lookup(cells, "v", choices).collect()}
    assert got == {
        "Active": ("active", "matched"), "ACTIVE": ("active", "matched"), "active": ("active", "matched"),
        "on": ("down", "matched"), "On": ("up", "matched"), "ON": (None, "ambiguous"), "retired": (None, "unmatched"),
    }


def test_branch_view_and_diff_round_trip(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    overlay = spark.createDataFrame([(2, "B", False), (3, None, True), (4, "d", False)], "id int, v string, _deleted boolean")
    view = joins.branch_view(base, overlay, "id", aware=["v"])
    assert values(view, "id", "v") == [(1, "a"), (2, "B"), (4, "d")]
    assert values(joins.branch_diff(base, view, "id", ["v"]), "id", "change") == [(2, "changed"), (3, "removed"), (4, "added")]


# --- ordered work -----------------------------------------------------------------------------------


def test_chunked_helpers_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(4)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, v int")
    chunk = scale.block_of(F.col("n"), 16)
    w = Window.partitionBy("k").orderBy("n")
    got = scale.ranked(df, ["k"], ["n"], chunk, "r")
    assert values(got, "k", "n", "r") == values(df.withColumn("r", F.row_number().over(w)), "k", "n", "r")
    got = scale.running_total(df, ["k"], ["n"], chunk, F.col("v"), "s")
    assert values(got, "k", "n", "s") == values(df.withColumn("s", F.sum("v").over(w)), "k", "n", "s")
    got = scale.with_previous(df, ["k"], ["n"], chunk, ["v"], "p").select("k", "n", F.coalesce("p.v", F.lit(-1)).alias("p"))
    want = df.withColumn("p", F.coalesce(F.lag("v").over(w), F.lit(-1)))
    assert values(got, "k", "n", "p") == values(want, "k", "n", "p")


@pytest.mark.parametrize("start", [0, windows.RANGE_BLOCK - 20])
def test_ranges(spark, start):
    rows = [("s1", f"eth{start + i}", "uplink" if i == 16 else "server") for i in range(48)]
    rows += [("s2", f"eth{start + i}", "server") for i in range(48)] + [("s3", f"et-0/0/{i}", None) for i in (1, 2, 3)]
    rows += [("s4", f"p0{i}", "a") for i in range(1, 6)] + [("s4", "mgmt", "a")]
    df = spark.createDataFrame(rows, "parent string, name string, role string")
    out = windows.collapse_ranges(df, "parent", "name", ["role"])
    a, b = start, start + 47
    assert values(out, "parent", "name") == sorted(
        [("s1", f"eth[{a}-{a + 15}]"), ("s1", f"eth{a + 16}"), ("s1", f"eth[{a + 17}-{b}]"), ("s2", f"eth[{a}-{b}]"),
         ("s3", "et-0/0/1"), ("s3", "et-0/0/2"), ("s3", "et-0/0/3"), ("s4", "p[01-05]"), ("s4", "mgmt")]
    )
    back = text.expand_range(out, "name").select("parent", "name", F.coalesce("role", F.lit("")))
    assert sorted(map(tuple, back.collect())) == sorted((p, n, r or "") for p, n, r in rows)


def test_incidents_across_midnight_and_root(spark):
    rows = [
        ("database", "2024-05-01 23:59:50", "java.lang.OutOfMemoryError"),
        *[("server", f"2024-05-02 00:0{i}:00", "Connection refused by 10.0.0.1") for i in range(1, 5)],
        ("task-worker", "2024-05-02 00:03:05", "timeout"),
        ("server", "2024-05-02 09:00:00", "unrelated"),
    ]
    df = spark.createDataFrame(rows, "service string, t string, msg string").withColumn("ts", F.to_timestamp("t")).withColumn("d", F.lit("x"))
    clustered = windows.incidents(df, ["d"], "ts", 300, tie=["service"])
    assert clustered.agg(F.max("incident")).first()[0] == 2
    roots = windows.root_candidate(clustered, ["d", "incident"], "service", ["ts"])
    assert values(roots, "incident", "service", "n_cascade") == [(1, "database", 5), (2, "server", 0)]
    repeats = agg.collapse_repeats(df.withColumn("t", text.error_template(F.col("msg"))), ["service", "t"], "ts")
    assert ("server", "Connection refused by <ip>", 4) in values(repeats, "service", "t", "n_lines")


def test_gap_equal_to_the_limit_stays_together(spark):
    df = spark.sql("SELECT 'x' d, timestamp_seconds(i) ts FROM VALUES (0), (300), (601) v(i)")
    assert windows.incidents(df, ["d"], "ts", 300).agg(F.max("incident")).first()[0] == 2


def test_allocation_is_stable_and_exhausts(spark):
    pools = spark.createDataFrame([("a", 10, 13), ("b", 1, 1)], "pool string, low long, high long")
    used = spark.createDataFrame([("a", 11, None), ("a", 12, 7)], "pool string, number long, r long")
    asks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 7), ("b", 9)], "pool string, r long")
    out = windows.allocate_next(asks, pools, used, requester="r", block=2)
    assert sorted(map(tuple, out.select("pool", "r", F.coalesce("number", F.lit(-1)), "status").collect())) == [
        ("a", 1, 10, "allocated"), ("a", 2, 13, "allocated"), ("a", 3, -1, "exhausted"), ("a", 7, 12, "kept"), ("b", 9, 1, "allocated"),
    ]


def test_tracebacks(spark):
    lines = ["ok", "Traceback (most recent call last):", '  File "/own/a.py", line 1, in f', '  File "/lib/b.py", line 2, in g', "own.SchemaNotFoundError: no branch x", "ok", "Traceback (most recent call last):", '  File "/lib/b.py", line 2, in g']
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "file string, line_no long, text string")
    out = windows.stitch_tracebacks(df, own_code="/own/", block=3).orderBy("line_no").collect()
    assert (out[0].line_no, out[0].exception_class, out[0].message) == (1, "own.SchemaNotFoundError", "no branch x")
    assert out[0].innermost_frame == 'File "/own/a.py", line 1, in f' and out[1].exception_class is None


def test_sorted_findings(spark):
    rows = [("r", 1, 1, "a"), ("r", 2, 1, "b"), ("r", 3, 2, "a"), ("q", 1, 2, "a"), ("q", 2, 1, "z")]
    df = spark.createDataFrame(rows, "report string, position int, ladder_step int, file string")
    assert values(windows.sort_breaks(df, ["report"], "position", ["ladder_step", "file"], block=1), "report", "position") == [("q", 2)]


# --- reconcile and graph ------------------------------------------------------------------------------


def test_reconcile_guard(spark):
    have = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(reconcile.EmptyDesiredState):
        reconcile.reconcile(have.where("false"), have, "id", ["v"])
    want = spark.createDataFrame([(1, None), (2, "b"), (2, "b"), (3, "c"), (3, "d"), (None, "x")], "id int, v string")
    plan = reconcile.reconcile(want, have, "id", ["v"])
    assert sorted(map(str, map(tuple, plan.select("id", "action", "v").collect()))) == [
        "(1, 'update', None)", "(2, 'create', 'b')", "(3, 'conflict', 'c')", "(None, 'conflict', 'x')",
    ]
    settled = plan.where("action IN ('update', 'create')").select("id", "v")
    assert {r.action for r in reconcile.reconcile(want.where("id < 3"), settled, "id", ["v"]).collect()} == {"keep"}
    wiped = reconcile.reconcile(have.where("false"), have, "id", ["v"], allow_empty=True)
    assert values(wiped, "id", "action") == [(1, "delete")]


def test_hierarchies_end(spark):
    rows = [("a", None), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "nobody"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "q")]
    rows += [(f"n{k:03}", f"n{k - 1:03}" if k else None) for k in range(70)]
    out = {r.node: r for r in graph.hierarchy_paths(spark.createDataFrame(rows, "child string, parent string")).collect()}
    assert len(out) == 78
    assert (out["n069"].path, out["n069"].level) == ("/".join(f"n{k:03}" for k in range(70)), 69)
    assert {n: out[n].status for n in "abcxypqr"} == {
        "a": "ok", "b": "second_parent", "c": "ok", "x": "orphan", "y": "orphan", "p": "cycle", "q": "cycle", "r": "cycle",
    }
    assert out["c"].path == "a/b/c" and out["y"].path == "x/y" and out["p"].path is None
    assert graph.hierarchy_paths(spark.createDataFrame([("p", "p")], "child string, parent string")).first().status == "cycle"


def test_limits_that_used_to_cut(spark):
    results = spark.range(12).selectExpr("'s' AS subject", "id AS check_order", "'c' || id AS check", "false AS passed")
    assert agg.score(results, "subject").first().failed_checks == ",".join(f"c{k}" for k in range(12))
    kinds = spark.range(800).selectExpr("lpad(id, 4, '0') AS kind", "9L AS level").union(spark.sql("SELECT 'deep', 99L"))
    prefixes = {r.kind: r.prefix for r in windows.load_order(kinds).collect()}
    assert (prefixes["deep"], prefixes["0000"], prefixes["0026"], prefixes["0702"], prefixes["0701"]) == ("100a", "010a", "010aa", "010aaa", "010zz")
    issues = spark.range(1001).selectExpr("id AS issue", "'shared word' AS text")
    found = corpus.known_issue_scores(
        spark.sql("SELECT 1 AS s, 'shared' AS t"), issues, subject="s", subject_text="t", issue="issue", issue_text="text"
    )
    assert found.count() == 1001 and found.where("score < 1").count() == 0
    nested = spark.createDataFrame([('{"id":"a","children":{"kind":"k","data":[{"id":"b","children":{"kind":"k","data":[{"id":"c"}]}}]}}',)], "d string")
    rows, problems = graph.unnest_children(nested, "d", [], key="id", depth=2)
    assert values(rows, "node") == [("a",), ("b",)] and values(problems, "node", "level", "reason") == [("b", 1, "too_deep")]


def test_repeated_requests_get_one_number(spark):
    asks = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2)], "pool string, r long")
    pools = spark.createDataFrame([("p", 1, 5)], "pool string, low long, high long")
    used = spark.createDataFrame([], "pool string, number long, r long")
    assert values(windows.allocate_next(asks, pools, used, requester="r"), "r", "number") == [(1, 1), (2, 2)]


def test_tracebacks_behind_a_prefix(spark):
    lines = ["2024-01-01 ERROR Traceback (most recent call last):", '  File "/own/a.py", line 1', "ValueError: no", "INFO ok",
             "Traceback (most recent call last):", '  File "/own/b.py", line 2', "2024-01-01 INFO next"]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "file string, line_no long, text string")
    out = windows.stitch_tracebacks(df, own_code="/own/").orderBy("line_no").collect()
    assert [(r.exception_class, r.innermost_frame) for r in out] == [("ValueError", 'File "/own/a.py", line 1'), (None, 'File "/own/b.py", line 2')]


def test_nested_blocks_keep_all_children(spark):
    df = spark.range(25).selectExpr("'p' AS parent", "id")
    out = reconcile.nest_components(df, "parent", kind="C", columns=["id"], order=["id"], chunk=scale.block_of(F.col("id"), 4), block_size=10)
    data = [(r.block, [x.id for x in r.children.data]) for r in out.orderBy("block").collect()]
    assert data == [(0, list(range(10))), (10, list(range(10, 20))), (20, list(range(20, 25)))]


def test_graph_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reachable(seeds, edges), "node", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert values(graph.reachable(seeds, edges, max_depth=1), "node") == [("a",), ("b",)]
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    refs = spark.createDataFrame([("f", "e"), ("a", "b"), ("b", "a"), ("c", "a"), ("d", "gone")], "src string, dst string")
    levels = {r.node: r.level for r in graph.dependency_levels(nodes, refs).collect()}
    assert levels == {"a": None, "b": None, "c": None, "d": 0, "e": 0, "f": 1}


# --- scalars ------------------------------------------------------------------------------------------


def test_header_mapping(spark):
    headers = ["Name", "Memory (GB)", "CPU Count", "Role", "Status", "Memory (TB)", "rack  u POSITION", "colour"]
    attributes = [("name", "Name"), ("memory_gb", None), ("cpu_count", None), ("role", None), ("status", None), ("rack_u", "Rack U Position")]
    out = text.map_columns(
        spark.createDataFrame([(h,) for h in headers], "header string"),
        spark.createDataFrame(attributes, "name string, label string"),
    )
    got = {r.header: (r.attribute, r.status) for r in out.collect()}
    assert got == {
        "Name": ("name", "mapped"), "Memory (GB)": ("memory_gb", "mapped"), "CPU Count": ("cpu_count", "mapped"),
        "Role": ("role", "mapped"), "Status": ("status", "mapped"), "Memory (TB)": (None, "ambiguous"),
        "rack  u POSITION": ("rack_u", "mapped"), "colour": (None, "unmapped"),
    }


def test_cells(spark):
    df = spark.createDataFrame([("maybe", "64GB", "01/02/2024", "{bad", "N/A"), ("Y", "1_000", "2024-01-15", "[1]", " x ")], "b string, n string, d string, j string, e string")
    out = df.select(
        coerce.to_boolean(F.col("b")), coerce.to_number(F.col("n")), F.date_format(coerce.to_datetime(F.col("d")), "yyyy-MM-dd"),
        coerce.to_json_value(F.col("j")).isNotNull(), coerce.blank_to_null(F.col("e")),
    ).collect()
    assert [tuple(r) for r in out] == [(None, None, "2024-01-02", False, None), (True, 1000.0, "2024-01-15", True, "x")]
    orders = {"ambiguous": ["01/02/2024", "03/04/2024"], coerce.DAY_FIRST: ["01/02/2024", "31/01/2024"], "neither": ["31/01/2024", "01/31/2024"]}
    for want, cells in orders.items():
        col = spark.createDataFrame([(c,) for c in cells], "c string")
        assert col.agg(coerce.slash_order(F.col("c"))).first()[0] == want
    assert not df.select(coerce.to_json_value(F.lit('{"a": 1}}')).isNotNull()).first()[0]


def test_redaction_and_leaks(spark):
    raw = "see https://app.acme.corp/x and db.acme.local at 10.50.12.7, /Users/alice/x, a@b.org, 127.0.0.1"
    df = spark.createDataFrame([(1, raw), (2, "<internal-ip> near 10.9.8.7 but 192.0.2.10 is fine")], "id int, t string")
    cleaned = df.select(text.redact(F.col("t"))).first()[0]
    for word in ("acme", "10.50", "alice", "b.org"):
        assert word not in cleaned
    assert "127.0.0.1" in cleaned
    assert "<internal-url>" in cleaned and "<path>" in cleaned and "<email>" in cleaned
    leaks = text.detect_leaks(df, F.col("t"), ["id"])
    assert values(leaks.where("leak = 'ipv4'"), "id", "found") == [(1, "10.50.12.7")]
    close = spark.createDataFrame([(3, "<redacted> 1.2.3.4 5.6.7.8"), (4, "~/x or /users/ann or c:\\users\\bob")], "id int, t string")
    found = values(text.detect_leaks(close, F.col("t"), ["id"]), "id", "leak", "found")
    assert found == [(4, "user_path", "/users/ann"), (4, "user_path", "c:\\users\\bob"), (4, "user_path", "~/x")]
    assert text.container_rule(["db", "db-1"])[0] == r"\b(?:db\-1|db)\b"


def test_versions(spark):
    df = spark.createDataFrame([("1.2.4", "1.2.2"), ("1.2.4", "1.3.0"), ("1.2.4", None), ("1.10", "1.9.5"), ("1.2", "1.2.1"), ("1.2.3.4.5", "1.2.3.4.9"), ("1.2.3", "1.2.4rc1"), ("1.2.4rc1", "1.2.4"), ("1.2.4", "1.2.4rc2"), ("1.0", "1"), ("?", "1.0")], "r string, f string")
    assert [r[0] for r in df.select(text.fix_status(F.col("r"), F.col("f"))).collect()] == [
        "unconfirmed", "upgrade", "undetermined", "unconfirmed", "upgrade", "upgrade", "upgrade", "upgrade", "unconfirmed", "unconfirmed", "undetermined",
    ]


def test_templates_keep_the_class(spark):
    df = spark.createDataFrame([("app.core.SchemaNotFoundError: Unable to load x.y.com",), ("app.core.LockError: Unable to load x.y.com",)], "m string")
    assert values(df.select(text.error_template(F.col("m")).alias("t")), "t") == [("LockError: Unable to load <host>",), ("SchemaNotFoundError: Unable to load <host>",)]


# --- corpora ------------------------------------------------------------------------------------------


def test_seed_scan_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    seeds = ["Quarrendon Vantis", "of the", "e", "ation", "the and", "tion on", "er.\nth", "öß"]
    needles = spark.createDataFrame([(s,) for s in seeds], "seed string").select(text.normalised(F.col("seed")).alias("needle"))
    got = values(corpus.seed_scan(docs, "doc_id", "text", needles), "doc_id", "needle")
    rows = docs.select("doc_id", text.normalised(F.col("text")).alias("low")).collect()
    want = sorted((r.doc_id, n.needle) for r in rows for n in needles.collect() if n.needle in r.low)
    assert got == want and want


def test_seed_tokens(spark):
    seeds = spark.createDataFrame([("Quarrendon  Vantis",), ("/Users/pkirin/x",)], "s string")
    assert [r[0] for r in values(corpus.seed_needles(seeds, "s"), "needle")] == ["/users/pkirin/x", "pkirin", "quarrendon", "quarrendon vantis", "vantis"]


def test_shape_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    shapes = {}
    for i in range(120):
        base = rng.choice([range(4), range(10, 30), range(5, 22), range(40, 47)])
        shapes[i] = frozenset(x for x in base if rng.random() > 0.12) or frozenset({99})
    rows = [(i, f"a{x}") for i, s in shapes.items() for x in s]
    out = corpus.shape_duplicates(spark.createDataFrame(rows, "node int, attr string"), "node", "attr")
    first = {}
    for i, s in shapes.items():
        first.setdefault(s, i)
    want = sorted(
        (first[s], len(s), sum(o == s for o in shapes.values()), n) for s in first
        if (n := sum(len(s & o) * 100 > len(s | o) * 70 for o in shapes.values())) >= 3
    )
    assert values(out, "shape", "n_attributes", "n_nodes", "n_alike") == want and want


def test_negation_and_fences(spark):
    rows = [(1, "please do not run rm -rf x"), (2, "run rm -rf x"), (3, "do not\n```\nrm -rf x\n```\n"), (4, "rm -rf a, never rm -rf b")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = corpus.forbidden_mentions(df, "t", r"rm\s+-rf", ["id"])
    assert values(out, "id", "excused") == [(1, True), (2, False), (3, False), (4, False), (4, True)]


def test_bounded_tokens(spark):
    df = spark.createDataFrame([("480 IOPS",), ("4800",), ("v1.2.4.",), ("11.2.4",), ("1.2.42",)], "t string")
    assert [r[0] for r in df.select(corpus.has_number(F.col("t"), "480")).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(corpus.has_version(F.col("t"), "1.2.4")).collect()] == [False, False, True, False, False]


def test_scratch_is_removed(spark):
    with scale.scratch(spark):
        kept = scale.cut(spark.range(5))
        assert kept.count() == 5
        place = kept.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)not exist|not found|No such file"):
        spark.read.parquet(place).count()


# --- sources ------------------------------------------------------------------------------------------


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_bytes("﻿name;description;memory\nCisco;a,b;64,5\n\nJuniper;\"c;d\";1\n".encode())
    (tmp_path / "a" / "y.TSV").write_text("name\trole\nspine\tcore\n")
    (tmp_path / "z.csv").write_bytes("name,city\nA,Zürich €\n".encode("cp1252"))
    (tmp_path / "note.json").write_text("{}")
    paths = [str(tmp_path / "z.csv"), str(tmp_path / "a")]
    dialects = {r.header: (r.encoding, r.delimiter, r.decimal) for r in delimited.sniff_dialect(spark, paths).collect()}
    assert dialects == {
        "name;description;memory": ("utf-8", ";", ","), "name\trole": ("utf-8", "\t", "."), "name,city": ("windows-1252", ",", "."),
    }
    rows = delimited.read_delimited(spark, paths).orderBy("_input_rank", "_line").collect()
    assert [(r.name, r.description, r.memory, r.role, r.city, r._line) for r in rows] == [
        ("A", None, None, None, "Zürich €", 2), ("Cisco", "a,b", "64,5", None, None, 2), ("Juniper", "c;d", "1", None, None, 4),
        ("spine", None, None, "core", None, 2),
    ]
    with pytest.raises(checks.GateClosed, match="note.json"):
        delimited.read_delimited(spark, [*paths, str(tmp_path / "note.json")])
    (tmp_path / "q.csv").write_text('"Name, full",role\n"x,y",5" rack\n"",""\n')
    quoted = delimited.read_delimited(spark, [str(tmp_path / "q.csv")]).orderBy("_line").collect()
    assert [(r["Name, full"], r.role) for r in quoted][0] == ("x,y", '5" rack')
    (tmp_path / "bytes.csv").write_bytes(b"name,note\na,\x81\n")
    assert delimited.read_delimited(spark, [str(tmp_path / "bytes.csv")]).first().note == "\x81"
    (tmp_path / "wide.csv").write_bytes("name,note\na,b\n".encode("utf-16"))
    (tmp_path / "tie.csv").write_text('name;note\tx\na;b\tc\n')
    with pytest.raises(checks.GateClosed, match=r"(?s)NUL bytes.*wide.csv.*; no clear delimiter.*tie.csv.*, 0 | ; 1 | tab 1"):
        delimited.read_delimited(spark, [str(tmp_path / "wide.csv"), str(tmp_path / "tie.csv")])


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


@pytest.mark.parametrize(("delimiter", "ending", "quote"), [(",", "\n", '"'), (";", "\r\n", '"'), ("\t", "\n", "'")])
def test_records_over_lines(spark, tmp_path, small_splits, delimiter, ending, quote):
    rng = random.Random(4)
    pool = ["x", "yy", delimiter, ending, quote, "é", " ", ending + ending, quote + quote]
    rows = [["id", "one", "two"]]
    for k in range(300):
        rows.append([str(k), *("a" + "".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(2))])
    path = tmp_path / ("m.tsv" if delimiter == "\t" else "m.csv")
    with path.open("w", newline="", encoding="utf-8") as file:
        csv.writer(file, delimiter=delimiter, quotechar=quote, lineterminator=ending).writerows(rows)
    with path.open(newline="", encoding="utf-8") as file:
        reader, lines = csv.reader(file, delimiter=delimiter, quotechar=quote), []
        want = []
        for cells in reader:
            want.append((*cells, (lines[-1] if lines else 0) + 1))
            lines.append(reader.line_num)
    got = delimited.read_delimited(spark, [str(path)])
    assert got.rdd.getNumPartitions() > 1
    assert sorted((r.id, r.one, r.two, r._line) for r in got.collect()) == sorted(want[1:])


def test_quotes_that_are_no_cells_and_megabyte_cells(spark, tmp_path):
    long = "line of a cell, longer than it should be\n" * 50_000
    text = 'name,note\na,5" rack\nb,"two ""x"" ' + long + '"\nc,it"s\nd,""\ne,"""q"""\nf,"a"\n'
    (tmp_path / "cells.csv").write_text(text)
    got = {r.name: (r.note, r._line) for r in delimited.read_delimited(spark, [str(tmp_path / "cells.csv")]).collect()}
    assert got == {
        "a": ('5" rack', 2), "b": ('two "x" ' + long, 3), "c": ('it"s', 50_004), "d": (None, 50_005), "e": ('"q"', 50_006), "f": ("a", 50_007),
    }
    with pytest.raises(checks.GateClosed, match="a record of more than 5 lines in .*cells.csv, line 3, byte 20"):
        delimited.read_delimited(spark, [str(tmp_path / "cells.csv")], most_lines=5)


def test_quotes_that_never_close(spark, tmp_path, small_splits):
    lines = "".join(f"{k},n{k}\n" for k in range(200))
    (tmp_path / "open.csv").write_text("name,note\n" + lines + 'x,"never\n' + lines)
    (tmp_path / "ok.csv").write_text("name,note\n" + lines)
    offset = len("name,note\n" + lines)
    with pytest.raises(checks.GateClosed, match=f"quotes that never close in .*open.csv, line 202, byte {offset}$"):
        delimited.read_delimited(spark, [str(tmp_path / "open.csv"), str(tmp_path / "ok.csv")])
    (tmp_path / "head.csv").write_text('name,"no\nte"\na,b\n')
    with pytest.raises(checks.GateClosed, match="a header that goes on"):
        delimited.read_delimited(spark, [str(tmp_path / "head.csv")])


def test_log_bundle(spark, tmp_path):
    for name, lines in {
        "database/db-0.log": ["2024-05-01T14:02:11Z ERROR java.lang.OutOfMemoryError"],
        "task-worker/w-1.previous.log": ["2024-05-01 14:03:05,123 [WARN] timeout", "no time here"],
    }.items():
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True)
        path.write_text("\n".join(lines) + "\n")
    rows = documents.read_log_bundle(spark, str(tmp_path)).orderBy("service", "line_no").collect()
    assert [(r.service, r.replica, r.is_previous, r.line_no, r.level, r.msg, r.ts is None) for r in rows] == [
        ("database", "db-0", False, 1, "ERROR", "java.lang.OutOfMemoryError", False),
        ("task-worker", "w-1", True, 1, "WARN", "timeout", False),
        ("task-worker", "w-1", True, 2, None, "no time here", True),
    ]


def test_artifact_types(spark, tmp_path):
    df = spark.createDataFrame([("t", "x")], "target string, c string")
    with pytest.raises(ValueError):
        sinks.write_artifacts(df, "target", F.col("c"), "application/pdf", str(tmp_path / "o"))


def test_scorecard(spark):
    rows = [("a", 47, 4), ("b", 312, 14), ("c", 47, 0), ("d", 22, 2)]
    checked = spark.createDataFrame([(p, c) for p, c, _ in rows], "policy string, checked long")
    failed = spark.createDataFrame([(p, f) for p, _, f in rows], "policy string, failed long")
    out = {r.policy: (r.passed, r.checked, r.pct, r.status) for r in agg.scorecard(checked, failed).collect()}
    assert out["OVERALL"] == (408, 428, 95.3, "WARN") and out["c"] == (47, 47, 100.0, "PASS")


def test_import_gate_and_decisions(spark, tmp_path):
    kinds = [
        importing.Kind("site", "name", (importing.Attribute("name"), importing.Attribute("height", "", "Number"))),
        importing.Kind("rack", "id", (importing.Attribute("id", "", "Integer"), importing.Attribute("site", "", refers="site"), importing.Attribute("live", "", "Boolean"))),
    ]
    (tmp_path / "site.csv").write_text('Name;Height (m);colour\n"A";1,5;red\n"B\nb";2,5;\n')
    (tmp_path / "rack.csv").write_text("id,site,live\n1,A,yes\n2,C,maybe\n,A,no\n1,A,yes\n")
    sources = {"site": [str(tmp_path / "site.csv")], "rack": [str(tmp_path / "rack.csv")]}
    ready = importing.draft(spark, sources, kinds)
    found = sorted((r.kind, r.column, r.code, r.cell, r.line) for r in ready.issues.collect())
    assert found == [
        ("rack", "id", "required_blank", None, 4), ("rack", "live", "not_a_boolean", "maybe", 3), ("rack", "site", "orphan", "C", None),
        ("site", "colour", "unmapped", None, None),
    ]
    target = tmp_path / "out"
    with pytest.raises(checks.GateClosed, match="4 open issues: .*colour"):
        importing.emit(ready, str(target))
    assert not target.exists() and sum(len(p.read_text().splitlines()) for p in (tmp_path / "out-issues").glob("*.json")) == 4
    decided = spark.createDataFrame([(k, c, code) for k, c, code, *_ in found], "kind string, column string, code string")
    prefixes = importing.emit(importing.draft(spark, sources, kinds, decided), str(tmp_path / "again"))
    assert prefixes == {"site": "01", "rack": "02"}
    rows = sorted(line for p in (tmp_path / "again").rglob("*.txt") for line in p.read_text().splitlines())
    assert [json.loads(r)["spec"]["data"][0] for r in rows] == [
        {"id": 1, "site": "A", "live": True}, {"id": 2, "site": "C"}, {"name": "A", "height": 1.5}, {"name": "B\nb", "height": 2.5},
    ]


def test_load_prefixes(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "c"), ("d", "d")]
    assert sinks.load_prefixes(spark, "abcd", pairs) == {"a": "01", "b": "02a", "c": "02b", "d": "03"}
    with pytest.raises(checks.GateClosed, match="kinds that refer to each other"):
        sinks.load_prefixes(spark, "ab", [("a", "b"), ("b", "a")])
    frames = {"a": spark.range(2)}
    with pytest.raises(checks.GateClosed, match="open issues"):
        sinks.write_load_set(frames, [], "/nowhere", issues=spark.range(3))


def test_fail_closed_reports_a_bounded_list(spark):
    with pytest.raises(checks.GateClosed, match="^500 findings: id=[0-9]+; id=[0-9]+; and 498 more$"):
        checks.fail_closed(spark.range(500), "findings", show=2)
