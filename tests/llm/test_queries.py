"""Every query of the subpackage with SQL gives the SQL's rows on the smallest test tables; those without give rows of a stable schema."""

import os

import pytest

from lumenfold.llm.queries import QUERIES, SQL
from tests.tables import SF, duck_tables, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


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
