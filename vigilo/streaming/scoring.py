"""The scoring topology as Structured Streaming queries.

Two independent stateless flows (sensor readings, user events) feed one
output topic.  They reuse the batch functions unchanged -- parse, score,
filter, envelope -- so a stream run over some records equals the batch
query over the same records.  No state store is involved: each micro-batch
is a narrow map/filter, one task per input partition (Kafka partition or
file split), so throughput scales with partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from vigilo.operators import messages as M
from vigilo.operators import scoring as S


def sensor_flow(messages: DataFrame, now: Column | None = None) -> DataFrame:
    return S.sensor_anomalies(M.accepted(M.parse_sensor(messages)), now)


def user_flow(messages: DataFrame, now: Column | None = None) -> DataFrame:
    return S.user_anomalies(M.accepted(M.parse_user(messages)), now)


def sensor_dead_letter_flow(messages: DataFrame) -> DataFrame:
    return M.dead_letters(M.parse_sensor(messages))


def sensor_output_records(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Output-topic records ``(topic, key, value)`` of the sensor flow."""
    return S.prediction_messages(sensor_flow(messages, now), S.SENSOR_OUTPUT)


def user_output_records(messages: DataFrame, now: Column | None = None) -> DataFrame:
    return S.prediction_messages(user_flow(messages, now), S.USER_OUTPUT)
