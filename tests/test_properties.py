"""Property checks of the scoring rules against a plain-Python statement."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilo.operators import scoring as S


def expected(t, h):
    t_pts = 0
    if t > 35 or t < 5:
        t_pts = 3
    elif t > 30 or t < 10:
        t_pts = 1
    h_pts = 2 if (h > 85 or h < 10) else 0
    return t_pts + h_pts


values = st.one_of(st.floats(-50, 120, allow_nan=False), st.sampled_from(
    [5.0, 10.0, 30.0, 35.0, 85.0, 4.999999, 35.000001, float("nan")]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(values, values), min_size=1, max_size=40))
def test_score_matches_statement(spark, pairs):
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(pairs)],
                               "event_id long, temperature double, humidity double")
    rows = S.score_sensor(df).collect()
    for r in rows:
        t, h = pairs[r["event_id"]]
        # NaN compares false everywhere in the rules.
        want = expected(t if not math.isnan(t) else 20.0, h if not math.isnan(h) else 50.0)
        assert r["anomaly_score"] == want
        assert r["anomaly_score"] in {0, 1, 2, 3, 5}
        assert (r["ml_prediction"] == "ANOMALY_DETECTED") == (r["anomaly_score"] > 2)
