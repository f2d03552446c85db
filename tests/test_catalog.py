"""Every query of the catalogue runs, and equals its SQL where there is any."""

import pytest

import __spark_entry__
from pressgrid.plans import catalog
from tests.conftest import SMALL
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["entity_a", "entity_b", "shared"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_training_data_part():
    from pathlib import Path

    import pressgrid

    for p in Path(pressgrid.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
