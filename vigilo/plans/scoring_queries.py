"""Named queries for message parsing and rule scoring (batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.functions.rules import iso_instant
from vigilo.operators import messages as M
from vigilo.operators import scoring as S
from vigilo.operators.metrics import epoch_micros
from vigilo.sources.messages import sensor_messages, user_messages
from vigilo.sources.tables import read_table


def _no_processing_time(df: DataFrame) -> DataFrame:
    return df.drop(*S.PROCESSING_TIME)


def sensor_readings(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    return M.accepted(M.parse_sensor(sensor_messages(spark, sf_dir, varied)))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accepted(M.parse_user(user_messages(spark, sf_dir)))


def q_sensor_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: sensor messages -> parse -> score -> keep score > 0."""
    return _no_processing_time(S.sensor_anomalies(sensor_readings(spark, sf_dir)))


def q_sensor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = M.parse_sensor(sensor_messages(spark, sf_dir, varied=True))
    return parsed.select("event_id", "parse_ok", "sensor_id", "original_timestamp",
                         "temperature", "humidity")


def q_user_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = M.parse_user(user_messages(spark, sf_dir, varied=True))
    return parsed.select("event_id", "parse_ok", "user_id", "action", "page_id")


def q_user_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dead_letters(M.parse_user(user_messages(spark, sf_dir, varied=True)))


def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dead_letters(M.parse_sensor(sensor_messages(spark, sf_dir, varied=True)))


def q_varied_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring over the varied messages: lenient reads feed the rules."""
    return _no_processing_time(S.sensor_anomalies(sensor_readings(spark, sf_dir, varied=True)))


def q_user_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _no_processing_time(S.user_anomalies(user_events(spark, sf_dir)))


def q_all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = S.sensor_anomalies(sensor_readings(spark, sf_dir))
    user = S.user_anomalies(user_events(spark, sf_dir))
    return _no_processing_time(S.all_predictions(sensor, user))


# Processing time pinned for the reproducible form of the output records
# (an instant with an explicit zone, so the session time zone is irrelevant).
PINNED_NOW = "2024-02-01T00:00:00Z"


def pinned_now():
    return F.lit(PINNED_NOW).cast("timestamp")


def q_prediction_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output topic records: both flows as JSON text, processing time pinned."""
    now = pinned_now()
    sensor = S.prediction_messages(S.sensor_anomalies(sensor_readings(spark, sf_dir), now),
                                   S.SENSOR_OUTPUT)
    user = S.prediction_messages(S.user_anomalies(user_events(spark, sf_dir), now),
                                 S.USER_OUTPUT)
    return sensor.unionByName(user)


def q_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = S.sensor_audit_lines(sensor_readings(spark, sf_dir)) \
        .withColumn("source", F.lit("sensor-data"))
    user = S.user_audit_lines(user_events(spark, sf_dir)).withColumn("source", F.lit("user-events"))
    return sensor.unionByName(user)


def q_instant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as the instant text of the output records: fractions of six,
    three and no digits."""
    ts = F.timestamp_micros(epoch_micros(F.col("ts")))
    return read_table(spark, sf_dir, "events", ["event_id", "ts"]).select(
        "event_id", iso_instant(ts).alias("micros"),
        iso_instant(F.date_trunc("millisecond", ts)).alias("millis"), iso_instant(F.date_trunc("second", ts)).alias("seconds"))


QUERIES = {
    "instant_text": q_instant_text,
    "sensor_anomalies": q_sensor_anomalies,
    "sensor_parse": q_sensor_parse,
    "user_parse": q_user_parse,
    "dead_letters": q_dead_letters,
    "user_dead_letters": q_user_dead_letters,
    "varied_anomalies": q_varied_anomalies,
    "user_anomalies": q_user_anomalies,
    "all_predictions": q_all_predictions,
    "prediction_messages": q_prediction_messages,
    "audit_lines": q_audit_lines,
}
