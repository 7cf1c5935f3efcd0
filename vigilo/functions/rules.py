"""Threshold scoring rules for sensor readings and user events.

Pure column expressions: they are used unchanged by the batch queries and
by the streaming queries, and compile into whole-stage generated code.

Comparisons are strict.  Spark orders NaN above every number (so
``NaN > 35`` is true), whereas the rules treat NaN as "no comparison
holds"; every upper-bound test is therefore guarded with ``isnan``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's output exactly.
TEMP_HIGH = 35.0          # above: HIGH_TEMPERATURE, 3 points, CRITICAL
TEMP_LOW = 5.0            # below: LOW_TEMPERATURE, 3 points, CRITICAL
TEMP_WARN_HIGH = 30.0     # above (or below TEMP_WARN_LOW): TEMP_WARNING, 1 point
TEMP_WARN_LOW = 10.0
HUMIDITY_HIGH = 85.0      # above: HIGH_HUMIDITY, 2 points
HUMIDITY_LOW = 10.0       # below: LOW_HUMIDITY, 2 points
PAGE_ID_LIMIT = 45        # user events: page_id above this is suspicious
SENSOR_MODEL = "threshold-anomaly-detector-v1.0"
USER_MODEL = "user-behavior-detector-v1.0"
PROCESSOR = "kafka-streams"
SENSOR_SOURCE = "sensor-data"
USER_SOURCE = "user-events"
OUTPUT_TOPIC = "ml-predictions"


def _above(x: Column, bound: float) -> Column:
    return (x > F.lit(bound)) & ~F.isnan(x)


def temperature_reason(t: Column) -> Column:
    """First matching temperature class, or NULL."""
    return (F.when(_above(t, TEMP_HIGH), F.lit("HIGH_TEMPERATURE"))
            .when(t < F.lit(TEMP_LOW), F.lit("LOW_TEMPERATURE"))
            .when(_above(t, TEMP_WARN_HIGH) | (t < F.lit(TEMP_WARN_LOW)), F.lit("TEMP_WARNING")))


def humidity_reason(h: Column) -> Column:
    return (F.when(_above(h, HUMIDITY_HIGH), F.lit("HIGH_HUMIDITY"))
            .when(h < F.lit(HUMIDITY_LOW), F.lit("LOW_HUMIDITY")))


def temperature_points(reason: Column) -> Column:
    return (F.when(reason == "TEMP_WARNING", F.lit(1))
            .when(reason.isNotNull(), F.lit(3)).otherwise(F.lit(0)))


def humidity_points(reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.lit(2)).otherwise(F.lit(0))


def sensor_reason_columns(t: Column, h: Column) -> dict[str, Column]:
    """Step 1: the temperature and humidity classes (NULL = no class)."""
    return {"t_reason": temperature_reason(t), "h_reason": humidity_reason(h)}


def sensor_score_columns(t_reason: Column, h_reason: Column) -> dict[str, Column]:
    """Step 2, from the classes of step 1, in output order.

    Score is the sum of the two class points (one of 0, 1, 2, 3, 5).  A
    critical temperature sets CRITICAL; any other positive score is a
    WARNING (humidity can only lift NORMAL to WARNING).
    """
    t_pts = temperature_points(t_reason)
    score = t_pts + humidity_points(h_reason)
    return {
        "ml_prediction": F.when(score > 2, F.lit("ANOMALY_DETECTED"))
                          .otherwise(F.lit("WARNING_DETECTED")),
        "alert_level": F.when(t_pts == 3, F.lit("CRITICAL"))
                        .when(score > 0, F.lit("WARNING")).otherwise(F.lit("NORMAL")),
        "anomaly_score": score,
        # JSON text, temperature reason first, no spaces: ["A","B"] / [].
        "anomaly_reasons": reasons_json(t_reason, h_reason),
    }


def reasons_json(*reasons: Column) -> Column:
    """JSON array text of the non-NULL reasons (``concat_ws`` skips NULLs;
    unlike ``array_compact`` it stays inside generated code)."""
    quoted = [F.concat(F.lit('"'), r, F.lit('"')) for r in reasons]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def user_is_suspicious(page_id: Column) -> Column:
    return page_id > F.lit(PAGE_ID_LIMIT)


def user_score_columns() -> dict[str, Column]:
    return {
        "ml_prediction": F.lit("SUSPICIOUS_BEHAVIOR"),
        "alert_level": F.lit("WARNING"),
        "anomaly_score": F.lit(1),
        "anomaly_reasons": F.lit('["HIGH_PAGE_ACCESS"]'),
    }


def iso_instant(ts: Column) -> Column:
    """ISO-8601 UTC text of an instant (``...Z``), whatever the session
    time zone is, with 0, 3 or 6 fraction digits: as many groups of three as
    it needs."""
    text = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(text, r"(?:\.000000|(?<=\.\d{3})000)Z$", "Z")


def java_double_text(x: Column) -> Column:
    """Double as text the way the audit log prints it (``36.0``)."""
    return x.cast("string")
