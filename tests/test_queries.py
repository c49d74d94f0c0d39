"""Every registered query with SQL text gives the same rows as that text in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    _, message = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert message.startswith("ok"), message


def test_entry_has_a_stable_schema(spark):
    d = entry.entry(spark)
    assert d.columns == ["bucket", "n", "bucket_mean", "rate"]
    assert d.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
