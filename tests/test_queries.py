"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_point
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_oracles_name_queries():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_fewshot_sample_does_not_depend_on_partitioning(spark):
    from catalog.fixtures import mc_problems
    from gradeframe.operators.expand import fewshot_sample

    rows = mc_problems(spark, SF)
    picks = [
        [r.uuid for r in fewshot_sample(rows.repartition(n), 5, seed=2).collect()] for n in (1, 7)
    ]
    assert picks[0] == picks[1] and len(set(picks[0])) == 5
    assert picks[0] != [r.uuid for r in fewshot_sample(rows, 5, seed=3).collect()]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_seeds_of_dialogues_are_read_from_written_turns(spark):
    """Runs that share their seeds do not number the turns once more each."""
    from catalog.queries import _seeds

    plan = _seeds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
