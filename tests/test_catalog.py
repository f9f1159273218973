import pytest

from lodeseek.plans import catalog, maintenance  # noqa: F401
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


def test_every_query_has_sql():
    assert catalog.SQL.keys() == catalog.QUERIES.keys()


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
