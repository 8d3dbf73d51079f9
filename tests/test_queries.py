"""Every registered measurement query against its SQL on the smallest tables."""

import pytest

from plumbline.plans import registry

from .compare import SMALL, duck, same


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLE_SQL:
        assert same(got, con.execute(registry.ORACLE_SQL[name]).df()) == ""
    assert len(got.columns) > 0


def test_every_query_names_its_inventory_rows():
    assert all(registry.COVERS[n].split() for n in registry.QUERIES)
