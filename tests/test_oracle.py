"""Every query that has oracle SQL equals DuckDB over the same tables."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck_connect

from paths import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    problems, n, _, _ = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems, problems


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["event_id", "key", "original_timestamp"]
    assert df.count() > 0


def test_every_query_is_registered_with_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert all(callable(f) for f in QUERIES.values())


@pytest.fixture()
def pacific(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


TIME_SENSITIVE = ["sensor_anomalies", "prediction_messages", "format_times", "metric_select",
                  "metric_range", "metric_sum_by", "metric_rate", "metric_last", "topic_records",
                  "csv_scan", "stream_resume", "stratified_split", "food_clean"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_results_do_not_depend_on_session_time_zone(pacific, duck, name):
    problems, n, _, _ = compare(pacific, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems, problems
