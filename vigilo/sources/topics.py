"""Topic-shaped records ``(topic, partition, offset, timestamp, key, value)``.

``topic_records`` binds ``events`` to that shape: topic = event type,
partition = user_id % 9, offset = position in (topic, partition) by
event_id.  In production the records come from a Kafka source, which
supplies partition and offset itself (see :mod:`vigilo.streaming.io`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilo.operators.split import stratified_rank
from vigilo.sources.tables import read_table, written_once

PARTITIONS = 9


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic: written once per application, as a broker would hold it."""
    return written_once(spark, sf_dir, ["events"], "topic-records", lambda: _bound(spark, sf_dir))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type",
                                                  "value"])
    shaped = events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        "event_id", F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    # Offsets: a rank inside (topic, partition) that never gathers a whole
    # partition of the topic into one task.
    ranked = stratified_rank(shaped, ["topic", "partition"], ["event_id"], name="rank")
    return ranked.select("topic", "partition", (F.col("rank") - 1).cast("long").alias("offset"),
                         "timestamp", "key", "value", "event_id")


def peek(records: DataFrame, n: int) -> DataFrame:
    """First ``n`` retained records of each topic by (partition, offset).

    Offsets need not start at 0 or be dense (retention, compaction,
    transactions), so records are ranked: first within each partition of a
    topic, where Spark limits every task to ``n`` rows per partition before
    the shuffle, then within the topic over what is left."""
    rank = F.row_number()
    head = records.withColumn("__rn", rank.over(Window.partitionBy("topic", "partition").orderBy("offset"))) \
        .where(F.col("__rn") <= n)
    topic = Window.partitionBy("topic").orderBy("partition", "offset")
    return head.withColumn("__rn", rank.over(topic)).where(F.col("__rn") <= n).drop("__rn")


def totals(records: DataFrame) -> DataFrame:
    """Messages per topic: sum over partitions of (last offset + 1)."""
    ends = records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    return ends.groupBy("topic").agg(F.sum("end_offset").alias("messages"))
