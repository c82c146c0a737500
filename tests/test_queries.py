"""Every registered query against its SQL, on the smallest data."""

import math

import pytest

from docloom.plans import registry
from tests.conftest import SMALL


def comparable(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


def rows_of(names, columns, rows):
    order = [columns.index(n) for n in names]
    return sorted((str([comparable(row[i]) for i in order]) for row in rows))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMALL)
    rel = duck.sql(registry.ORACLES[name])
    names = sorted(frame.columns)
    assert names == sorted(rel.columns)
    got, want = rows_of(names, frame.columns, frame.collect()), rows_of(names, list(rel.columns), rel.fetchall())
    assert got == want and (got or name == "anti_promoted")


def test_every_query_is_registered_in_the_entry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
