"""Table-driven rule cases at every boundary, and the lenient-read cases."""

import json

import pytest
from pyspark.sql import functions as F

from vigilo.operators import messages as M
from vigilo.operators import scoring as S


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


# (temperature, humidity) -> (score, level, label, reasons); None = dropped.
SENSOR_CASES = [
    (20, 50, None),
    (35, 50, (1, "WARNING", "WARNING_DETECTED", '["TEMP_WARNING"]')),
    (35.1, 50, (3, "CRITICAL", "ANOMALY_DETECTED", '["HIGH_TEMPERATURE"]')),
    (30, 50, None),
    (30.1, 50, (1, "WARNING", "WARNING_DETECTED", '["TEMP_WARNING"]')),
    (10, 50, None),
    (9.9, 50, (1, "WARNING", "WARNING_DETECTED", '["TEMP_WARNING"]')),
    (5, 50, (1, "WARNING", "WARNING_DETECTED", '["TEMP_WARNING"]')),
    (4.9, 50, (3, "CRITICAL", "ANOMALY_DETECTED", '["LOW_TEMPERATURE"]')),
    (20, 85, None),
    (20, 86, (2, "WARNING", "WARNING_DETECTED", '["HIGH_HUMIDITY"]')),
    (20, 10, None),
    (20, 9, (2, "WARNING", "WARNING_DETECTED", '["LOW_HUMIDITY"]')),
    (32, 90, (3, "WARNING", "ANOMALY_DETECTED", '["TEMP_WARNING","HIGH_HUMIDITY"]')),
    (40, 5, (5, "CRITICAL", "ANOMALY_DETECTED", '["HIGH_TEMPERATURE","LOW_HUMIDITY"]')),
    ("NaN", 50, None),
    (None, 50, (3, "CRITICAL", "ANOMALY_DETECTED", '["LOW_TEMPERATURE"]')),
]


def _sensor_text(t, h):
    return json.dumps({"timestamp": "2024-01-01 10:00:00", "sensor_id": "sensor_1",
                       "temperature": t, "humidity": h})


def _score(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, value string")
    out = S.sensor_anomalies(M.accepted(M.parse_sensor(df)), now())
    return {r["event_id"]: r for r in out.collect()}


def test_sensor_boundaries(spark):
    got = _score(spark, [_sensor_text(t, h) for t, h, _ in SENSOR_CASES])
    for i, (t, h, want) in enumerate(SENSOR_CASES):
        if want is None:
            assert i not in got, (t, h)
        else:
            r = got[i]
            assert (r["anomaly_score"], r["alert_level"], r["ml_prediction"],
                    r["anomaly_reasons"]) == want, (t, h)


def test_envelope_fields_and_time(spark):
    got = _score(spark, [_sensor_text(40, 5)])[0]
    assert got["timestamp"] == "2024-01-01T00:00:00Z"
    assert got["processing_epoch"] == 1704067200
    assert got["processor"] == "kafka-streams"
    assert got["ml_model"] == "threshold-anomaly-detector-v1.0"
    assert got["source"] == "sensor-data"
    assert got["original_timestamp"] == "2024-01-01 10:00:00"


@pytest.mark.parametrize("text,error", [
    ("{'temperature': 40, 'humidity': 5, 'sensor_id': 's', 'timestamp': 't'}", "unparseable"),
    ('{"temperature": 40, "humidity": 5', "unparseable"),
    ("", "unparseable"),
    ('[{"temperature": 40}]', "not_an_object"),
    ("17", "not_an_object"),
    ('{"humidity": 5, "sensor_id": "s", "timestamp": "t"}', "missing_field:temperature"),
])
def test_dead_letters(spark, text, error):
    df = spark.createDataFrame([(0, text)], "event_id long, value string")
    dead = M.dead_letters(M.parse_sensor(df)).collect()
    assert [r["error"] for r in dead] == [error]


def test_lenient_accepts(spark):
    texts = [
        '{"temperature": 40, "humidity": 50, "sensor_id": "s", "timestamp": "t"} trailing',
        '{"temperature": 20, "humidity": 50, "humidity": 5, "sensor_id": "s", "timestamp": "t"}',
        '{"temperature": "36.5", "humidity": 50, "sensor_id": "s", "timestamp": "t"}',
        '{"temperature": 20, "humidity": 50, "sensor_id": 7, "timestamp": null}',
    ]
    got = _score(spark, texts)
    assert got[0]["anomaly_reasons"] == '["HIGH_TEMPERATURE"]'
    assert got[1]["anomaly_reasons"] == '["LOW_HUMIDITY"]'     # last duplicate wins
    assert got[2]["temperature"] == 36.5
    parsed = M.parse_sensor(spark.createDataFrame([(3, texts[3])], "event_id long, value string"))
    row = parsed.first()
    assert row["parse_ok"] and row["sensor_id"] == "7" and row["original_timestamp"] == "null"


@pytest.mark.parametrize("page,emitted", [(45, False), (46, True), ('"46.7"', True)])
def test_user_threshold(spark, page, emitted):
    text = f'{{"user_id": 7, "action": "click", "page_id": {page}}}'
    df = spark.createDataFrame([(0, text)], "event_id long, value string")
    out = S.user_anomalies(M.accepted(M.parse_user(df)), now()).collect()
    assert bool(out) == emitted
    if emitted:
        assert out[0]["page_id"] == 46 and out[0]["anomaly_reasons"] == '["HIGH_PAGE_ACCESS"]'


def test_user_missing_field_is_dead_letter(spark):
    df = spark.createDataFrame([(0, '{"user_id": 7, "action": "click"}')], "event_id long, value string")
    assert M.dead_letters(M.parse_user(df)).first()["error"] == "missing_field:page_id"


def test_audit_line_format(spark):
    df = spark.createDataFrame([(0, _sensor_text(36, 50)), (1, _sensor_text(20, 50))],
                               "event_id long, value string")
    lines = {r["event_id"]: r["line"] for r in
             S.sensor_audit_lines(M.accepted(M.parse_sensor(df))).collect()}
    assert lines[0] == "ANOMALY DETECTED: sensor_1 - CRITICAL (T:36.0°C, H:50.0%, Score:3)"
    assert lines[1] == "NORMAL: sensor_1 - NORMAL (T:20.0°C, H:50.0%, Score:0)"
