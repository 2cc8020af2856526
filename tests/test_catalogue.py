import pytest

import __spark_entry__ as entry
from kithmark.plans import catalogue
from tests.oracle import connect, rows

SLOW = {"gbt_cv", "gbt_cv_by_record", "forest_cv", "cv_summary", "gbt_predict"}


@pytest.mark.parametrize("name", sorted(n for n in catalogue.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - SLOW))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_classifier_beats_chance(spark, sf_dir):
    r = catalogue.QUERIES["forest_cv"](spark, sf_dir).toPandas()
    assert len(r) == 5 and r["f05"].mean() > 0.6


def test_flagship(spark):
    assert entry.entry(spark).columns == ["source1_entity_id", "candidate_entity_ids"]
