"""Every query outside llm against its SQL twin on whole tables; those without SQL must run."""

import pytest

from paperloom.plans import catalog
from tests.compare import assert_same, database


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, data, con, name):
    assert_same(catalog.QUERIES[name](spark, data), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_core_does_not_import_llm():
    import pathlib

    import paperloom

    root = pathlib.Path(paperloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "paperloom.llm" not in p.read_text()
