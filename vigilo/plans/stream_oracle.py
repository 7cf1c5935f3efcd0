"""Oracle SQL for the streaming queries: a stream run must equal the
batch result over the same records, so the batch oracles apply."""

from vigilo.plans.scoring_oracle import (DEAD_LETTERS, PREDICTION_MESSAGES, SENSOR_ANOMALIES,
                                         USER_ANOMALIES, V_SENSOR, VARIED_ANOMALIES, VARIED_AUDIT_LINES)

STREAM_SOURCE = f"""
WITH {V_SENSOR}
SELECT 'sensor-data' AS topic, sensor_id AS "key",
  json_object('timestamp', "timestamp", 'sensor_id', sensor_id, 'temperature', temperature,
              'humidity', humidity)::VARCHAR AS value,
  event_id
FROM v_sensor"""

ORACLE = {
    "fanout_anomalies": VARIED_ANOMALIES,
    "fanout_dead_letters": DEAD_LETTERS,
    "fanout_audit_lines": VARIED_AUDIT_LINES,
    "topic_totals_kept": "SELECT event_type AS topic, count(*) AS messages FROM events GROUP BY event_type",
    "stream_source": STREAM_SOURCE,
    "stream_sensor": SENSOR_ANOMALIES,
    "stream_user": USER_ANOMALIES,
    "stream_dead_letters": DEAD_LETTERS,
    "stream_resume": SENSOR_ANOMALIES,
    "stream_sink": PREDICTION_MESSAGES,
}
