import pytest

from paperloom.llm import catalog
from tests.compare import assert_same, database


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, data, name):
    if name in ("p1_gold", "p8_items"):  # right repairs and labels are too few in the smallest data
        data = data.replace("sf0.001", "sf0.01")
    assert_same(catalog.QUERIES[name](spark, data), database(data), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, data, name):
    out = catalog.QUERIES[name](spark, data)
    assert out.count() >= 0 and out.columns
