import pytest
from oracle import DATA, difference

from weftline.registry import ORACLES, QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], DATA / "sf0.001") is None


def test_every_sql_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()
