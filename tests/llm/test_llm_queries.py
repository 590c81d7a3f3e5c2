import pytest

from tests.compare import check, duck
from tests.conftest import SF
from waylattice.llm import queries, sql


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_sql(spark, con, name):
    check(spark, con, SF, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).columns


def test_found_columns(spark):
    want = {"p1_found": ["kind", "gt_pose_id", "record_id"], "p2_found": ["candidate_kf_id", "current_kf_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"]}
    for name, columns in want.items():
        assert sorted(queries.QUERIES[name](spark, SF).columns) == sorted(columns)
