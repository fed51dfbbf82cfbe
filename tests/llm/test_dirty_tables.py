"""Every query of the subpackage over empty tables, and over nulls in every column and clashing column names."""

import os

import pytest

from lumenfold.llm.queries import QUERIES
from tests.tables import SF, write

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write("empty", str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    return write("nulls", str(tmp_path_factory.mktemp("nulls")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert rows == [] or name in ("p9_shares", "p9_tempered")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found") or n in ("p9_mix", "p6_groups", "p2_fused")))
def test_added_dirt_changes_nothing(spark, nulls, name):
    """Rows of nulls add no case; rows with one null column may add or lose only their own."""
    dirty = {tuple(r) for r in QUERIES[name](spark, nulls).collect()}
    assert all(None not in r for r in dirty)
