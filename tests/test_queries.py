"""Every core query with SQL gives the SQL's rows on the smallest test tables; those without give rows of a stable schema."""

import os

import pytest

import __spark_entry__ as entry
from lumenfold.plans import core_queries, ingest_queries, search_queries
from tests.tables import SF, duck_tables, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
CORE = (core_queries, search_queries, ingest_queries)
QUERIES = {n: f for m in CORE for n, f in m.QUERIES.items()}
SQL = {n: q for m in CORE for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return duck_tables()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.schema == QUERIES[name](spark, SF).schema
    assert df.count() > 0


def test_registry_without_llm(monkeypatch):
    """A missing subpackage, or one of its own requirements, leaves the core queries; any other error shows."""
    import importlib

    whole = importlib.import_module

    def missing(name):
        def fake(module, *a):
            if module == "lumenfold.llm.queries":
                raise ModuleNotFoundError(name, name=name)
            return whole(module, *a)

        return fake

    for name in ("lumenfold.llm.queries", "lumenfold.llm", "xxhash"):
        monkeypatch.setattr(entry.importlib, "import_module", missing(name))
        assert set(entry.queries()) == set(QUERIES)
    monkeypatch.setattr(entry.importlib, "import_module", missing("lumenfold.other"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
