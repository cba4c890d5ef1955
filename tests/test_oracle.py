import pytest

from driftloom.plans import catalog
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.01"  # at sf0.001 two queries have no rows to compare
CON = {}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_is_its_sql(spark, name):
    run, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF).columns and run(spark, SF).count() > 0
        return
    con = CON.setdefault(SF, connection(SF))
    assert compare(spark, con, run, sql, SF) is None
