"""DuckDB oracle SQL for the scoring queries.

Written independently of the Spark code: bindings are typed SELECTs over
``events`` and the rules are plain CASE expressions.  Message text, where
an output needs it, is built with DuckDB's own JSON functions.
"""

V_SENSOR = """
v_sensor AS (
  SELECT event_id, event_type,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
         'sensor_' || CAST(user_id % 20 AS VARCHAR) AS sensor_id,
         value - 10.0 AS temperature,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS humidity
  FROM events)"""

V_USER = """
v_user AS (
  SELECT event_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
         CAST(user_id AS INTEGER) AS user_id,
         event_type AS action,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS page_id
  FROM events)"""

# Message text per row, with the same shape rules as the Spark binding.
V_SENSOR_MSG = V_SENSOR + """,
sensor_text AS (
  SELECT *, json_object('timestamp', "timestamp", 'sensor_id', sensor_id,
                        'temperature', temperature, 'humidity', humidity)::VARCHAR AS clean
  FROM v_sensor),
v_sensor_msg AS (
  SELECT event_id, 'sensor-data' AS topic, sensor_id AS "key",
    CASE
      WHEN event_type = 'error' AND humidity < 10 THEN substr(clean, 1, length(clean) - 1)
      WHEN event_type = 'error' AND humidity < 20 THEN replace(clean, '"', '''')
      WHEN event_type = 'click' AND humidity < 10 THEN
        json_object('timestamp', "timestamp", 'sensor_id', sensor_id, 'temperature', temperature)::VARCHAR
      WHEN event_type = 'click' AND humidity < 20 THEN '[' || clean || ']'
      WHEN event_type = 'purchase' AND humidity < 10 THEN ''
      WHEN event_type = 'view' AND humidity < 10 THEN
        json_object('timestamp', "timestamp", 'sensor_id', sensor_id,
                    'temperature', CAST(temperature AS VARCHAR), 'humidity', humidity)::VARCHAR
      WHEN event_type = 'view' AND humidity < 20 THEN
        json_object('timestamp', "timestamp", 'sensor_id', sensor_id,
                    'temperature', NULL, 'humidity', humidity)::VARCHAR
      ELSE clean END AS value
  FROM sensor_text),
sensor_checked AS (
  SELECT *,
    CASE WHEN NOT json_valid(value) THEN 'unparseable'
         WHEN json_type(value) <> 'OBJECT' THEN 'not_an_object'
         WHEN NOT json_exists(value, '$.temperature') THEN 'missing_field:temperature'
         WHEN NOT json_exists(value, '$.humidity') THEN 'missing_field:humidity'
         WHEN NOT json_exists(value, '$.sensor_id') THEN 'missing_field:sensor_id'
         WHEN NOT json_exists(value, '$.timestamp') THEN 'missing_field:timestamp'
    END AS parse_error
  FROM v_sensor_msg),
sensor_parsed AS (
  SELECT event_id, topic, "key", value, parse_error, parse_error IS NULL AS parse_ok,
    CASE WHEN parse_error IS NULL THEN json_extract_string(value, '$.sensor_id') END AS sensor_id,
    CASE WHEN parse_error IS NULL THEN json_extract_string(value, '$.timestamp') END AS original_timestamp,
    CASE WHEN parse_error IS NULL THEN
      coalesce(TRY_CAST(json_extract_string(value, '$.temperature') AS DOUBLE), 0.0) END AS temperature,
    CASE WHEN parse_error IS NULL THEN
      coalesce(TRY_CAST(json_extract_string(value, '$.humidity') AS DOUBLE), 0.0) END AS humidity
  FROM sensor_checked)"""


def _sensor_rules(src: str) -> str:
    return f"""
reasons AS (
  SELECT *,
    CASE WHEN temperature > 35 THEN 'HIGH_TEMPERATURE'
         WHEN temperature < 5 THEN 'LOW_TEMPERATURE'
         WHEN temperature > 30 OR temperature < 10 THEN 'TEMP_WARNING' END AS t_reason,
    CASE WHEN humidity > 85 THEN 'HIGH_HUMIDITY'
         WHEN humidity < 10 THEN 'LOW_HUMIDITY' END AS h_reason
  FROM {src}),
scored AS (
  SELECT *,
    CAST(CASE WHEN t_reason = 'TEMP_WARNING' THEN 1 WHEN t_reason IS NOT NULL THEN 3 ELSE 0 END
       + CASE WHEN h_reason IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS anomaly_score
  FROM reasons),
sensor_out AS (
  SELECT event_id, "key", original_timestamp,
    'kafka-streams' AS processor, 'threshold-anomaly-detector-v1.0' AS ml_model,
    'sensor-data' AS source, sensor_id, CAST(temperature AS DOUBLE) AS temperature,
    CAST(humidity AS DOUBLE) AS humidity,
    CASE WHEN anomaly_score > 2 THEN 'ANOMALY_DETECTED' ELSE 'WARNING_DETECTED' END AS ml_prediction,
    CASE WHEN t_reason IN ('HIGH_TEMPERATURE', 'LOW_TEMPERATURE') THEN 'CRITICAL'
         WHEN anomaly_score > 0 THEN 'WARNING' ELSE 'NORMAL' END AS alert_level,
    anomaly_score,
    '[' || concat_ws(',', '"' || t_reason || '"', '"' || h_reason || '"') || ']' AS anomaly_reasons
  FROM scored WHERE anomaly_score > 0)"""


SENSOR_ANOMALIES = f"""
WITH {V_SENSOR},
readings AS (SELECT event_id, sensor_id AS "key", "timestamp" AS original_timestamp, sensor_id,
                    temperature, humidity FROM v_sensor),
{_sensor_rules('readings')}
SELECT * FROM sensor_out"""

VARIED_ANOMALIES = f"""
WITH {V_SENSOR_MSG},
readings AS (SELECT * FROM sensor_parsed WHERE parse_ok),
{_sensor_rules('readings')}
SELECT * FROM sensor_out"""

SENSOR_PARSE = f"""
WITH {V_SENSOR_MSG}
SELECT event_id, parse_ok, sensor_id, original_timestamp, temperature, humidity FROM sensor_parsed"""

DEAD_LETTERS = f"""
WITH {V_SENSOR_MSG}
SELECT topic, "key", value, event_id, parse_error AS error FROM sensor_parsed WHERE NOT parse_ok"""

V_USER_MSG = V_USER + """,
user_text AS (
  SELECT *, json_object('timestamp', "timestamp", 'user_id', user_id, 'action', action,
                        'page_id', page_id)::VARCHAR AS clean
  FROM v_user),
v_user_msg AS (
  SELECT event_id, 'user-events' AS topic, CAST(user_id AS VARCHAR) AS "key",
    CASE
      WHEN action = 'error' AND page_id < 10 THEN
        json_object('timestamp', "timestamp", 'user_id', user_id, 'action', action,
                    'page_id', CAST(page_id AS VARCHAR) || '.7')::VARCHAR
      WHEN action = 'click' AND page_id < 10 THEN
        json_object('timestamp', "timestamp", 'user_id', user_id, 'action', action,
                    'page_id', page_id + 0.9::DOUBLE)::VARCHAR
      WHEN action = 'view' AND page_id < 5 THEN
        json_object('timestamp', "timestamp", 'user_id', CAST(user_id AS BIGINT) + 1000000000000,
                    'action', action, 'page_id', page_id)::VARCHAR
      WHEN action = 'purchase' AND page_id < 5 THEN
        json_object('timestamp', "timestamp", 'user_id', user_id, 'page_id', page_id)::VARCHAR
      WHEN action = 'signup' AND page_id < 5 THEN '[' || clean || ']'
      ELSE clean END AS value
  FROM user_text),
user_num AS (
  SELECT *,
    CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN
      coalesce(TRY_CAST(json_extract_string(value, '$.user_id') AS DOUBLE), 0.0) END AS uid_d,
    CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN
      coalesce(TRY_CAST(json_extract_string(value, '$.page_id') AS DOUBLE), 0.0) END AS pid_d
  FROM v_user_msg),
user_checked AS (
  SELECT *,
    CASE WHEN NOT json_valid(value) THEN 'unparseable'
         WHEN json_type(value) <> 'OBJECT' THEN 'not_an_object'
         WHEN NOT json_exists(value, '$.user_id') THEN 'missing_field:user_id'
         WHEN NOT json_exists(value, '$.action') THEN 'missing_field:action'
         WHEN NOT json_exists(value, '$.page_id') THEN 'missing_field:page_id'
         WHEN trunc(uid_d) NOT BETWEEN -2147483648 AND 2147483647 THEN 'bad_integer:user_id'
         WHEN trunc(pid_d) NOT BETWEEN -2147483648 AND 2147483647 THEN 'bad_integer:page_id'
    END AS parse_error
  FROM user_num),
user_parsed AS (
  SELECT event_id, topic, "key", value, parse_error, parse_error IS NULL AS parse_ok,
    CASE WHEN parse_error IS NULL THEN CAST(trunc(uid_d) AS INTEGER) END AS user_id,
    CASE WHEN parse_error IS NULL THEN json_extract_string(value, '$.action') END AS action,
    CASE WHEN parse_error IS NULL THEN CAST(trunc(pid_d) AS INTEGER) END AS page_id
  FROM user_checked)"""

USER_PARSE = f"""
WITH {V_USER_MSG}
SELECT event_id, parse_ok, user_id, action, page_id FROM user_parsed"""

USER_DEAD_LETTERS = f"""
WITH {V_USER_MSG}
SELECT topic, "key", value, event_id, parse_error AS error FROM user_parsed WHERE NOT parse_ok"""

USER_OUT = f"""
{V_USER},
user_out AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS "key",
    'kafka-streams' AS processor, 'user-behavior-detector-v1.0' AS ml_model,
    'user-events' AS source, user_id, action, page_id,
    'SUSPICIOUS_BEHAVIOR' AS ml_prediction, 'WARNING' AS alert_level,
    CAST(1 AS INTEGER) AS anomaly_score, '["HIGH_PAGE_ACCESS"]' AS anomaly_reasons
  FROM v_user WHERE page_id > 45)"""

USER_ANOMALIES = f"""
WITH {USER_OUT}
SELECT * FROM user_out"""

ALL_PREDICTIONS = f"""
WITH {V_SENSOR},
readings AS (SELECT event_id, sensor_id AS "key", "timestamp" AS original_timestamp, sensor_id,
                    temperature, humidity FROM v_sensor),
{_sensor_rules('readings')},
{USER_OUT}
SELECT event_id, "key", original_timestamp, processor, ml_model, source, sensor_id, temperature,
       humidity, ml_prediction, alert_level, anomaly_score, anomaly_reasons,
       CAST(NULL AS INTEGER) AS user_id, CAST(NULL AS VARCHAR) AS action,
       CAST(NULL AS INTEGER) AS page_id
FROM sensor_out
UNION ALL
SELECT event_id, "key", NULL, processor, ml_model, source, NULL, NULL, NULL, ml_prediction,
       alert_level, anomaly_score, anomaly_reasons, user_id, action, page_id
FROM user_out"""

_AUDIT_SENSOR = """
audit_reasons AS (
  SELECT *,
    CASE WHEN temperature > 35 THEN 3 WHEN temperature < 5 THEN 3
         WHEN temperature > 30 OR temperature < 10 THEN 1 ELSE 0 END AS t_pts,
    CASE WHEN humidity > 85 OR humidity < 10 THEN 2 ELSE 0 END AS h_pts
  FROM readings),
lines AS (
  SELECT event_id,
    CASE WHEN t_pts + h_pts > 0 THEN
      'ANOMALY DETECTED: ' || sensor_id || ' - ' ||
      CASE WHEN t_pts = 3 THEN 'CRITICAL' ELSE 'WARNING' END
    ELSE 'NORMAL: ' || sensor_id || ' - NORMAL' END
    || ' (T:' || CAST(temperature AS VARCHAR) || '°C, H:' || CAST(CAST(humidity AS DOUBLE) AS VARCHAR)
    || '%, Score:' || CAST(t_pts + h_pts AS VARCHAR) || ')' AS line,
    'sensor-data' AS source
  FROM audit_reasons)"""

AUDIT_LINES = f"""
WITH {V_SENSOR},
readings AS (SELECT event_id, sensor_id AS "key", "timestamp" AS original_timestamp, sensor_id,
                    temperature, humidity FROM v_sensor),
{_AUDIT_SENSOR},
{V_USER}
SELECT * FROM lines
UNION ALL
SELECT event_id,
  CASE WHEN page_id > 45 THEN
    'USER ANOMALY: User ' || CAST(user_id AS VARCHAR) || ' accessing high page ID '
    || CAST(page_id AS VARCHAR) || ' - SUSPICIOUS_BEHAVIOR'
  ELSE 'USER NORMAL: User ' || CAST(user_id AS VARCHAR) || ' performed ' || action
    || ' on page ' || CAST(page_id AS VARCHAR) || ' - NORMAL_BEHAVIOR' END AS line,
  'user-events' AS source
FROM v_user"""

VARIED_AUDIT_LINES = f"""
WITH {V_SENSOR_MSG},
readings AS (SELECT * FROM sensor_parsed WHERE parse_ok),
{_AUDIT_SENSOR}
SELECT event_id, line FROM lines"""

PINNED_ISO = "2024-02-01T00:00:00Z"
PINNED_EPOCH = 1706745600

PREDICTION_MESSAGES = f"""
WITH {V_SENSOR},
readings AS (SELECT event_id, sensor_id AS "key", "timestamp" AS original_timestamp, sensor_id,
                    temperature, humidity FROM v_sensor),
{_sensor_rules('readings')},
{USER_OUT}
SELECT 'ml-predictions' AS topic, "key",
  json_object('timestamp', '{PINNED_ISO}', 'original_timestamp', original_timestamp,
    'processor', processor, 'ml_model', ml_model, 'source', source, 'sensor_id', sensor_id,
    'temperature', temperature, 'humidity', humidity, 'ml_prediction', ml_prediction,
    'alert_level', alert_level, 'anomaly_score', anomaly_score,
    'anomaly_reasons', anomaly_reasons, 'processing_epoch', {PINNED_EPOCH})::VARCHAR AS value,
  event_id
FROM sensor_out
UNION ALL
SELECT 'ml-predictions', "key",
  json_object('timestamp', '{PINNED_ISO}', 'processor', processor, 'ml_model', ml_model,
    'source', source, 'user_id', user_id, 'action', action, 'page_id', page_id,
    'ml_prediction', ml_prediction, 'alert_level', alert_level, 'anomaly_score', anomaly_score,
    'anomaly_reasons', anomaly_reasons, 'processing_epoch', {PINNED_EPOCH})::VARCHAR,
  event_id
FROM user_out"""

def _instant(expr: str) -> str:
    micros = f"epoch_us({expr}) % 1000000"
    return f"""strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN ''
      WHEN {micros} % 1000 = 0 THEN '.' || lpad(CAST({micros} // 1000 AS VARCHAR), 3, '0')
      ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END || 'Z'"""


ORACLE = {
    "instant_text": f"""SELECT event_id, {_instant("ts")} AS micros, {_instant("date_trunc('millisecond', ts)")} AS millis,
      {_instant("date_trunc('second', ts)")} AS seconds FROM events""",
    "prediction_messages": PREDICTION_MESSAGES,
    "sensor_anomalies": SENSOR_ANOMALIES,
    "sensor_parse": SENSOR_PARSE,
    "user_parse": USER_PARSE,
    "dead_letters": DEAD_LETTERS,
    "user_dead_letters": USER_DEAD_LETTERS,
    "varied_anomalies": VARIED_ANOMALIES,
    "user_anomalies": USER_ANOMALIES,
    "all_predictions": ALL_PREDICTIONS,
    "audit_lines": AUDIT_LINES,
}
