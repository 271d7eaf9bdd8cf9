import pytest

from deltaloom.plans import catalog
from oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    check(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL)


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, SMALL).count() > 0
