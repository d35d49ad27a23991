import pytest

from codequery.plans import catalog
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, SF).count() >= 0
    else:
        assert differs(spark, duck, name, catalog.queries()[name], sql, SF) is None
