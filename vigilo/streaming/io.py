"""Streaming sources and sinks for topic records.

``kafka`` is the production format (``key``/``value`` arrive as binary and
are cast to text).  The Kafka connector is not bundled with plain PySpark;
any file format (``parquet``, ``json``, ``text``) can stand in, with the
same column shape, which is how the tests drive the streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

TOPIC_SCHEMA = "topic string, key string, value string, event_id long"


def read_topic_stream(spark: SparkSession, topic: str, fmt: str = "kafka",
                      path: str | None = None, schema: StructType | str = TOPIC_SCHEMA,
                      options: dict[str, str] | None = None) -> DataFrame:
    """A stream of ``(topic, key, value, ...)`` records, from the earliest
    retained position on the first run (later runs resume from the
    query's checkpoint)."""
    options = dict(options or {})
    if fmt == "kafka":
        options.setdefault("startingOffsets", "earliest")
        raw = (spark.readStream.format("kafka").option("subscribe", topic)
               .options(**options).load())
        return raw.select("topic", "partition", "offset", "timestamp",
                          F.col("key").cast("string").alias("key"),
                          F.col("value").cast("string").alias("value"))
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def write_stream(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                 topic: str | None = None, available_now: bool = True,
                 query_name: str | None = None,
                 options: dict[str, str] | None = None) -> StreamingQuery:
    """Start an append-mode sink with a checkpoint.

    File sinks commit exactly once per micro-batch through their log;
    the Kafka sink is at-least-once (a replayed batch may repeat records).
    """
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if fmt == "kafka":
        writer = writer.format("kafka").option("topic", topic)
    else:
        writer = writer.format(fmt).option("path", sink)
    writer = writer.options(**(options or {}))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def run_until_caught_up(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for an ``availableNow`` run to finish (and surface its error).

    Without ``timeout_s`` it waits as long as the run takes; a caller that
    passes one gets a ``TimeoutError`` and a stopped query beyond it."""
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stream {query.name or query.id} did not finish in {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
