"""What is known by season is a few rows and is broadcast: no join deals the rows of a season to one task."""

import re

import pytest

from tallyframe import catalog


@pytest.mark.parametrize("name", ["eb3_season_to_date", "eb7_component_features", "eb8_current_state"])
def test_no_rows_are_dealt_by_season_for_a_join(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.findall(r"SortMergeJoin \[season#\d+\]", plan), plan
    assert re.findall(r"BroadcastHashJoin \[season#\d+\]", plan), plan
