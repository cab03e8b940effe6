"""Work and memory of one task that must not grow with the tables: plans, and what operators write on the way."""

import bz2
import gzip
import hashlib
import random
from itertools import pairwise
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from stewardry import scale
from stewardry.functions import text
from stewardry.operators import corpus, dictionary
from stewardry.plans import QUERIES
from stewardry.sources import sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def written(monkeypatch, module):
    """The frames a module cuts, by label."""
    real, made = module.cut, {}

    def watched(df, label="cut"):
        made[label] = real(df, label)
        return made[label]

    monkeypatch.setattr(module, "cut", watched)
    return made


@pytest.mark.parametrize("name", ["E2_collapse_ranges", "H11_expand_range"])
def test_ranges_are_dealt_to_as_many_tasks_as_rows_are_worth(spark, data, monkeypatch, name):
    monkeypatch.setattr(scale, "ROWS_A_TASK", 300)
    plan = plan_of(QUERIES[name](spark, data))
    assert "REPARTITION_BY_NUM" in plan
    assert "keys=[parent" not in plan.split("REPARTITION_BY_NUM")[-1]  # nothing is grouped before the rows are dealt


@pytest.mark.parametrize("name", ["C9_impact_rows", "C9_window_impact"])
def test_impact_is_dealt_to_as_many_tasks_as_rows_are_worth(spark, data, monkeypatch, name):
    monkeypatch.setattr(scale, "ROWS_A_TASK", 300)
    plan = plan_of(QUERIES[name](spark, data))
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "LeftSemi" in plan
    assert plan.count("Expand") == 0  # no row is repeated for each count


def test_hierarchies_are_dealt_to_as_many_tasks_as_rows_are_worth(spark, data, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_A_TASK", 300)
    plan = plan_of(QUERIES["L5_hierarchy_rules"](spark, data))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_length_caps_send_lengths_instead_of_texts(spark, data):
    above_the_join = optimized(QUERIES["H24_length_caps"](spark, data)).split("Join")[0]
    assert "_length" in above_the_join and "text#" not in above_the_join


def test_seed_hits_are_worked_out_once(spark, monkeypatch):
    made = written(monkeypatch, corpus)
    texts = spark.createDataFrame([(1, "a  b, c-d \U0001f600! x"), (2, "nothing"), (3, None)], "id long, text string")
    needles = ["b, c", "\U0001f600", "\U0001f600!", "-", " ", "!", "oth", "?"]
    hits = corpus.seed_scan(texts, "id", "text", spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = [(1, n) for n in needles if n in "a b, c-d \U0001f600! x"] + [(2, "oth")]
    assert rows_of(hits) == sorted(want, key=str)
    assert "hits" in made


def test_direct_inverses_list_no_places(spark, monkeypatch):
    made = written(monkeypatch, dictionary)
    kinds = spark.createDataFrame([("A", ["G"]), ("B", ["H"]), ("C", None), ("D", [])], "kind string, inherit_from array<string>")
    relations = [
        ("A", "a1", "B", "i1", "one"), ("B", "b1", "A", "i1", "many"),  # direct
        ("A", "a2", "B", "i2", "one"), ("H", "h2", "A", "i2", "many"),  # on a generic of the peer
        ("A", "a3", "B", "i3", "one"), ("B", "b3", "G", "i3", "many"),  # to a generic of the source
        ("A", "a4", "B", "i4", "one"), ("H", "h4", "G", "i4", "many"),  # between generics
        ("A", "a5", "B", "i5", "one"), ("H", "h5", "G", "i6", "many"),  # of another identifier
        ("C", "c1", "D", "i7", "one"), ("E", "e1", "F", "i8", "one"), ("A", "a9", "F", "i9", "one"), ("F", "f9", "G", "i9", "many"),
    ]
    rows = spark.createDataFrame([(*r, "Attribute") for r in relations], "kind string, name string, peer string, identifier string, cardinality string, rel_kind string")
    missing = dictionary.missing_inverses(kinds, rows)
    assert [r[1] for r in rows_of(missing.select("kind", "name"))] == ["a5", "c1", "e1"]
    assert "a1" not in {r["name"] for r in made["without-direct-inverse"].collect()}


def test_versions_are_read_once(spark):
    versions = ["1.0", "v2.0.0", "1", "1.2rc1", "1.2rc10", "1.2", "1.2.post1", "1.2+b", "1.2\nfoo", "1.10", "10", "0", "", "x1", None, "1.2.0", "1.2-dev"]
    df = spark.createDataFrame([(a, b) for a in versions for b in versions], "a string, b string")
    judged = df.withColumn("s", text.fix_status(F.col("a"), F.col("b")))
    assert optimized(judged).count("regexp_extract(") <= 10  # five for each of the two versions
    got = {(r.a, r.b): r.s for r in judged.collect()}
    order = ["0", "1", "1.2-dev", "1.2rc1", "1.2rc10", "1.2", "1.2.post1", "1.10", "10"]
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            assert got[a, b] == ("upgrade" if j > i else "unconfirmed"), (a, b)
    assert {got[a, b] for a in ("", "x1", None) for b in versions} == {"undetermined"}
    assert got["1.2", "1.2.0"] == got["1.2.0", "1.2"] == got["1.0", "1"] == "unconfirmed"


@pytest.fixture
def short_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def digests(spark, folder, contents):
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    found = sinks.file_digests(spark, [str(folder)]).collect()
    assert len(found) == len(contents)
    assert {unquote(r["_path"]).rsplit("/", 1)[-1]: (r["sha256"], r["bytes"]) for r in found} == {
        name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in contents.items()
    }


def test_a_digest_goes_on_from_task_to_task(spark, tmp_path, monkeypatch, short_splits):
    made = []
    monkeypatch.setattr(sinks, "new_path", lambda *a: made.append(scale.new_path(*a)) or made[-1], raising=False)
    monkeypatch.setattr(sinks, "BYTES_A_TASK", 10_000, raising=False)
    before = set(Path(scale.shared_dir(spark).removeprefix("file:")).glob("pieces-*"))
    rng = random.Random(2)
    # one line of the last runs over several rounds, in which the file has no bytes
    contents = {"long": rng.randbytes(70_000), "short": b"a,b\n" * 100, "lines": b"x" * 15_000 + b"\n" + b"y" * 42_000 + b"\nz"}
    digests(spark, tmp_path, contents)
    states = spark.read.parquet(made[0]).where("_path LIKE '%/long'").orderBy("round").collect()
    assert len(states) == 7 and all(b["_bytes"] - a["_bytes"] < 15_000 for a, b in pairwise(states))
    assert [s["sha256"] for s in states[:-1]] == [None] * 6
    assert set(Path(scale.shared_dir(spark).removeprefix("file:")).glob("pieces-*")) == before


def test_digests_of_marked_and_packed_files(spark, tmp_path, monkeypatch, short_splits):
    monkeypatch.setattr(sinks, "BYTES_A_TASK", 10_000, raising=False)
    mark, rng = b"\xef\xbb\xbf", random.Random(3)
    contents = {
        "a.csv": mark + b"a,b\n1,2\n", "b.csv": mark + b"a,b\n1,2", "c.csv": mark + b"\n", "d.csv": mark * 2 + b"x\n", "e.csv": b"a\n" + mark + b"b",
        "f g%20\u00e9.csv": mark + rng.randbytes(30_000),
        "h.csv.gz": gzip.compress(b"a,b\n1,2\n" * 99), "i.csv.bz2": bz2.compress(b"a,b\n" * 9), "j.GZ": b"not packed\n", "k.snappy": b"not packed",
    }
    digests(spark, tmp_path, contents)
