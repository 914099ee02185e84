"""The package's queries against SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from gradeframe.llm.oracles import ORACLES
from gradeframe.llm.queries import QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1], docs.schema)
    whole, good, exact, near, clean, packed = seen
    assert 0 < len(good) < len(whole)
    last = {}
    for x in good:
        last[x.text] = max(last.get(x.text, -1), x.doc_id)
    assert {x.doc_id for x in exact} == set(last.values())
    groups = brute.near_groups([(x.doc_id, x.text) for x in exact])
    assert {x.doc_id for x in near} == {c for _, c in groups.values()}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    told = brute.contaminated([(x.doc_id, x.text) for x in near], items)
    assert {x.doc_id for x in clean} == {k for k, v in told.items() if not v[-1]}
    assert {x.doc_id for x in packed} == {x.doc_id for x in clean}


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 0
