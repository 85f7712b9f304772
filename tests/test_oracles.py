"""Every query of the core against its SQL on the smallest test tables; the others must give rows."""

import oracle
import pytest

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf, name):
    if sf.endswith("sf0.001") and name == "pair_ladder_check":
        sf = sf.replace("sf0.001", "sf0.01")
    oracle.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    if sf.endswith("sf0.001") and name in ("pair_lr_scores", "pair_ladder"):
        sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has too few labelled pairs
    assert catalogue.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
