import oracle
import pytest

from panoquery.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_twin(spark, sf, name):
    assert oracle.rows(engine.QUERIES[name](spark, sf)) == oracle.twin(engine.ORACLE[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
