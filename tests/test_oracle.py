"""Every registered query against its oracle statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare
from schemahelm.plans import registry

# The corpus operators have tests of their own.
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
# Conditions that the smallest data set does not contain.
MAY_BE_EMPTY = {"j3_roles_of_user", "l1_selector_from_labels", "v11_has_all_labels", "w2_user_page"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        note = compare(df, duck, ORACLES[name])
        assert note is None or (note == "empty result" and name in MAY_BE_EMPTY), note
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
