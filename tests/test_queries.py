"""Every registered query against its SQL, run by DuckDB on the same tables."""

import pytest
from compare import same_rows

from propflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    result = registry.QUERIES[name](spark, sf_dir)
    if name in registry.SQL:
        same_rows(result, duck.execute(registry.SQL[name]).df())
    else:
        assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["listing_roundtrip_jsonld", "listing_roundtrip_og"])
def test_small_files_are_parsed_by_all_tasks(name, spark, sf_dir):
    """A file of few bytes and very many pages is read by one task, and must not be parsed by it alone."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    parsed = plan[plan.index("MapInArrow"):]
    assert "REPARTITION_BY_NUM" in parsed


def test_reviews_meet_clips_as_narrow_rows(spark, sf_dir):
    """Lists of issues are judged before the joins, and not held by them."""
    assert " AS issues#" not in registry.QUERIES["review_refusals"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
