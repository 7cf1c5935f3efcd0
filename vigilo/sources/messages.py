"""Topic-shaped message frames derived from the ``events`` table.

A topic record is ``(topic, key, value, event_id)`` with ``value`` the JSON
message text, as a Kafka source would deliver it (``value`` cast to
string).  The bindings are narrow projections of ``events``: no shuffle,
one output row per input row, so they scale with the table.

``varied=True`` rewrites some messages into the malformed or unusual
shapes the lenient reader must handle (truncated text, single quotes,
missing field, array root, empty text, numeric text, JSON null).  Which
shape a row takes is decided by its own ``event_type`` and ``props.k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.functions.rules import SENSOR_SOURCE, USER_SOURCE
from vigilo.sources.tables import read_table, spread

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_WITH_NULLS = {"ignoreNullFields": "false"}


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _text_ts() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss")


def sensor_readings(events: DataFrame) -> DataFrame:
    """Typed sensor readings bound to ``events`` (before serialisation)."""
    return events.select(
        "event_id", "event_type",
        _text_ts().alias("timestamp"),
        F.concat(F.lit("sensor_"), (F.col("user_id") % 20).cast("string")).alias("sensor_id"),
        (F.col("value") - F.lit(10.0)).alias("temperature"),
        _props_k().alias("humidity"),
    )


def user_actions(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        _text_ts().alias("timestamp"),
        F.col("user_id"),
        F.col("event_type").alias("action"),
        _props_k().alias("page_id"),
    )


def _sensor_text(r: dict[str, Column]) -> Column:
    return F.to_json(F.struct(r["timestamp"].alias("timestamp"), r["sensor_id"].alias("sensor_id"),
                              r["temperature"].alias("temperature"),
                              r["humidity"].alias("humidity")), _WITH_NULLS)


def _events(spark: SparkSession, sf_dir: str, where: Column | None) -> DataFrame:
    events = read_table(spark, sf_dir, "events", EVENT_COLUMNS)
    return spread(events.where(where) if where is not None else events, key="event_id")


def sensor_messages(spark: SparkSession, sf_dir: str, varied: bool = False,
                    where: Column | None = None) -> DataFrame:
    """``where`` (on the ``events`` columns) selects which records exist,
    e.g. the ones that have arrived by some time."""
    readings = sensor_readings(_events(spark, sf_dir, where))
    cols = {c: F.col(c) for c in ("timestamp", "sensor_id", "temperature", "humidity")}
    clean = _sensor_text(cols)
    value = clean
    if varied:
        kind = F.col("event_type")
        k = F.col("humidity")
        missing_humidity = F.to_json(F.struct("timestamp", "sensor_id", "temperature"))
        numeric_text = _sensor_text({**cols, "temperature": F.col("temperature").cast("string")})
        null_temp = _sensor_text({**cols, "temperature": F.lit(None).cast("double")})
        value = (F.when((kind == "error") & (k < 10), F.expr("substr(__clean, 1, length(__clean) - 1)"))
                 .when((kind == "error") & (k < 20), F.translate("__clean", '"', "'"))
                 .when((kind == "click") & (k < 10), missing_humidity)
                 .when((kind == "click") & (k < 20), F.concat(F.lit("["), F.col("__clean"), F.lit("]")))
                 .when((kind == "purchase") & (k < 10), F.lit(""))
                 .when((kind == "view") & (k < 10), numeric_text)
                 .when((kind == "view") & (k < 20), null_temp)
                 .otherwise(F.col("__clean")))
        readings = readings.withColumn("__clean", clean)
    return readings.select(
        F.lit(SENSOR_SOURCE).alias("topic"),
        F.col("sensor_id").alias("key"),
        value.alias("value"),
        "event_id",
    )


def user_messages(spark: SparkSession, sf_dir: str, where: Column | None = None,
                  varied: bool = False) -> DataFrame:
    """User-event messages; ``varied=True`` adds the integer shapes the
    lenient reader must handle (numeric text, fractional numbers, a value
    beyond 32 bits) and some unusable records."""
    actions = user_actions(_events(spark, sf_dir, where))
    value = F.to_json(F.struct("timestamp", "user_id", "action", "page_id"))
    if varied:
        kind, k = F.col("action"), F.col("page_id")
        text_page = F.to_json(F.struct("timestamp", "user_id", "action",
                                       F.concat(k.cast("string"), F.lit(".7")).alias("page_id")))
        frac_page = F.to_json(F.struct("timestamp", "user_id", "action",
                                       (k + F.lit(0.9)).alias("page_id")))
        huge_user = F.to_json(F.struct("timestamp",
                                       (F.col("user_id") + F.lit(10 ** 12)).alias("user_id"),
                                       "action", "page_id"))
        no_action = F.to_json(F.struct("timestamp", "user_id", "page_id"))
        value = (F.when((kind == "error") & (k < 10), text_page)
                 .when((kind == "click") & (k < 10), frac_page)
                 .when((kind == "view") & (k < 5), huge_user)
                 .when((kind == "purchase") & (k < 5), no_action)
                 .when((kind == "signup") & (k < 5), F.concat(F.lit("["), value, F.lit("]")))
                 .otherwise(value))
    return actions.select(
        F.lit(USER_SOURCE).alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        value.alias("value"),
        "event_id",
    )
