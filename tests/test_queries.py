"""Every registered query of the engine's own operators against its oracle at sf0.001."""

import pytest

import oracle
from gristmill.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert oracle.differences(spark, con, SF, QUERIES[name], ORACLE[name]) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_oracle_has_no_orphans():
    assert set(ORACLE) <= set(QUERIES)
