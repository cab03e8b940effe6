"""The registered corpus queries against their SQL, and the pipeline's stages."""

import pytest

import corpus_pipeline
from stewardry.llm import queries
from tests.oracle import connect, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    cursor = connect(data).execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(columns, cursor.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_secrets", "op8_quality_rules"])
def test_native_operators_run_no_python(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages_hand_documents_on(spark, data):
    raw = spark.read.parquet(f"{data}/documents.parquet")
    docs, counts = raw, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), raw.schema)
        assert docs.columns == raw.columns
        counts.append(docs.count())
    assert raw.count() > counts[0] == counts[1] > counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.where("start = 0").count() == counts[3]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_no_rows(spark, data, odd, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd, no_docs):
        out = stage(spark, docs, data)
        out.collect()
        if k < 4:
            assert out.columns == docs.columns
