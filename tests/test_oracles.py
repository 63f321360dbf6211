"""Every query that has an oracle gives the same rows as DuckDB."""

import pytest
from compare import connect, differences

from riskframe.plans.oracles import ORACLES
from riskframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []
