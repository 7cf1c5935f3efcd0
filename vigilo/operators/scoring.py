"""Rule scoring of parsed sensor readings and user events.

Each function is ``DataFrame -> DataFrame`` built from column expressions
only, so the whole chain (parse -> score -> filter -> envelope) is one
narrow, codegen'd stage with no shuffle.  The same functions are applied
to streaming frames by :mod:`vigilo.streaming.scoring`.

``now`` is the processing-time column (default ``current_timestamp()``,
which Spark fixes once per query or micro-batch); tests pass a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.functions import rules as R

SENSOR_OUTPUT = ["timestamp", "original_timestamp", "processor", "ml_model", "source",
                 "sensor_id", "temperature", "humidity", "ml_prediction", "alert_level",
                 "anomaly_score", "anomaly_reasons", "processing_epoch"]
USER_OUTPUT = ["timestamp", "processor", "ml_model", "source", "user_id", "action", "page_id",
               "ml_prediction", "alert_level", "anomaly_score", "anomaly_reasons",
               "processing_epoch"]
PROCESSING_TIME = ("timestamp", "processing_epoch")


def _now(now: Column | None) -> Column:
    return now if now is not None else F.current_timestamp()


def score_sensor(readings: DataFrame) -> DataFrame:
    """Add score, level, label and reasons to every reading (normal ones too)."""
    classed = readings.withColumns(R.sensor_reason_columns(F.col("temperature"), F.col("humidity")))
    return (classed.withColumns(R.sensor_score_columns(F.col("t_reason"), F.col("h_reason")))
            .drop("t_reason", "h_reason"))


def sensor_anomalies(readings: DataFrame, now: Column | None = None,
                     carry: tuple[str, ...] = ("event_id", "key")) -> DataFrame:
    """Readings with a positive score, as prediction records (13 fields)."""
    ts = _now(now)
    scored = score_sensor(readings).where(F.col("anomaly_score") > 0)
    record = scored.withColumns({
        "timestamp": R.iso_instant(ts),
        "processor": F.lit(R.PROCESSOR),
        "ml_model": F.lit(R.SENSOR_MODEL),
        "source": F.lit(R.SENSOR_SOURCE),
        "processing_epoch": F.unix_seconds(ts),
    })
    return record.select(*[c for c in carry if c in readings.columns], *SENSOR_OUTPUT)


def user_anomalies(events: DataFrame, now: Column | None = None,
                   carry: tuple[str, ...] = ("event_id", "key")) -> DataFrame:
    """User events above the page threshold, as prediction records (12 fields)."""
    ts = _now(now)
    record = (events.where(R.user_is_suspicious(F.col("page_id")))
              .withColumns({
                  "timestamp": R.iso_instant(ts),
                  "processor": F.lit(R.PROCESSOR),
                  "ml_model": F.lit(R.USER_MODEL),
                  "source": F.lit(R.USER_SOURCE),
                  **R.user_score_columns(),
                  "processing_epoch": F.unix_seconds(ts),
              }))
    return record.select(*[c for c in carry if c in events.columns], *USER_OUTPUT)


def all_predictions(sensor: DataFrame, user: DataFrame) -> DataFrame:
    """Both record shapes in one typed frame (missing fields are NULL)."""
    return sensor.unionByName(user, allowMissingColumns=True)


def prediction_messages(records: DataFrame, fields: list[str]) -> DataFrame:
    """Topic records ``(topic, key, value)``: the record as JSON text with
    a fixed field order, ready for a Kafka or text sink."""
    key = F.col("key") if "key" in records.columns else F.lit(None).cast("string")
    return records.select(
        F.lit(R.OUTPUT_TOPIC).alias("topic"), key.alias("key"),
        F.to_json(F.struct(*fields)).alias("value"),
        *[c for c in ("event_id",) if c in records.columns])


def sensor_audit_lines(readings: DataFrame) -> DataFrame:
    """One log line per reading, normal readings included."""
    s = score_sensor(readings)
    t = R.java_double_text(F.col("temperature"))
    h = R.java_double_text(F.col("humidity"))
    detail = F.concat(F.lit(" (T:"), t, F.lit("°C, H:"), h, F.lit("%, Score:"),
                      F.col("anomaly_score").cast("string"), F.lit(")"))
    line = F.when(F.col("anomaly_score") > 0,
                  F.concat(F.lit("ANOMALY DETECTED: "), F.col("sensor_id"), F.lit(" - "),
                           F.col("alert_level"), detail)) \
        .otherwise(F.concat(F.lit("NORMAL: "), F.col("sensor_id"), F.lit(" - NORMAL"), detail))
    return s.select("event_id", line.alias("line"))


def user_audit_lines(events: DataFrame) -> DataFrame:
    uid = F.col("user_id").cast("string")
    pid = F.col("page_id").cast("string")
    line = F.when(R.user_is_suspicious(F.col("page_id")),
                  F.concat(F.lit("USER ANOMALY: User "), uid, F.lit(" accessing high page ID "),
                           pid, F.lit(" - SUSPICIOUS_BEHAVIOR"))) \
        .otherwise(F.concat(F.lit("USER NORMAL: User "), uid, F.lit(" performed "),
                            F.col("action"), F.lit(" on page "), pid, F.lit(" - NORMAL_BEHAVIOR")))
    return events.select("event_id", line.alias("line"))
