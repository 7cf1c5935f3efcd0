"""Named queries that run the streaming flows and read their sinks back.

Input records are topic-shaped files that Spark derives from ``events``;
each stream runs with ``trigger(availableNow=True)`` (a bounded number of
bytes per micro-batch, whatever the size of the input) into a file sink
with a checkpoint, and the query returns the sink's contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators import messages as M
from vigilo.operators import scoring as S
from vigilo.plans.scoring_queries import pinned_now
from vigilo.session import scratch_path
from vigilo.sources.messages import sensor_messages, user_messages
from vigilo.sources.tables import read_table
from vigilo.streaming import fanout as FO
from vigilo.streaming import io as SIO
from vigilo.streaming import scoring as SF
from vigilo.streaming import totals as KT

# Input of one micro-batch; a larger backlog takes more batches, not larger ones.
BYTES_PER_TRIGGER = 64 << 30


def _stage(df: DataFrame, path: str) -> None:
    """Write topic records as the stream's input files (one file per
    partition: as parallel as the data already is)."""
    df.write.mode("append").parquet(path)


def _run(flow: DataFrame, root: str) -> None:
    q = SIO.write_stream(flow, f"{root}/sink", f"{root}/checkpoint")
    SIO.run_until_caught_up(q)


def _stream_of(spark: SparkSession, root: str, topic: str,
               bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """File stand-in for the topic."""
    return SIO.read_topic_stream(spark, topic, fmt="parquet", path=f"{root}/in",
                                 options={"maxBytesPerTrigger": str(bytes_per_trigger)})


def q_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic source alone: records read as a stream from the earliest
    position and landed unchanged (key and value as text)."""
    root = scratch_path(spark, "stream-source")
    _stage(sensor_messages(spark, sf_dir), f"{root}/in")
    _run(_stream_of(spark, root, "sensor-data"), root)
    return spark.read.parquet(f"{root}/sink")


def q_stream_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stream-sensor")
    _stage(sensor_messages(spark, sf_dir), f"{root}/in")
    _run(SF.sensor_flow(_stream_of(spark, root, "sensor-data")), root)
    return spark.read.parquet(f"{root}/sink").drop(*S.PROCESSING_TIME)


def q_stream_user(spark, sf_dir):
    root = scratch_path(spark, "stream-user")
    _stage(user_messages(spark, sf_dir), f"{root}/in")
    _run(SF.user_flow(_stream_of(spark, root, "user-events")), root)
    return spark.read.parquet(f"{root}/sink").drop(*S.PROCESSING_TIME)


def q_stream_dead_letters(spark, sf_dir):
    root = scratch_path(spark, "stream-dlq")
    _stage(sensor_messages(spark, sf_dir, varied=True), f"{root}/in")
    _run(SF.sensor_dead_letter_flow(_stream_of(spark, root, "sensor-data")), root)
    return spark.read.parquet(f"{root}/sink")


def q_stream_resume(spark, sf_dir):
    """Two arrivals, two runs on one checkpoint: the second run processes
    only the new files, so the sink holds every anomaly exactly once."""
    root = scratch_path(spark, "stream-resume")
    # Older records arrive first: split at the middle of the event-time range.
    span = read_table(spark, sf_dir, "events", ["ts"]).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    mid = F.lit((span["lo"] + (span["hi"] - span["lo"]) / 2).isoformat(sep=" ")) \
        .cast("timestamp_ntz")
    first = sensor_messages(spark, sf_dir, where=F.col("ts") <= mid)
    later = sensor_messages(spark, sf_dir, where=F.col("ts") > mid)
    _stage(first, f"{root}/in")
    _run(SF.sensor_flow(_stream_of(spark, root, "sensor-data")), root)
    _stage(later, f"{root}/in")
    _run(SF.sensor_flow(_stream_of(spark, root, "sensor-data")), root)
    return spark.read.parquet(f"{root}/sink").drop(*S.PROCESSING_TIME)


def q_stream_sink(spark, sf_dir):
    """Both flows into one output "topic" as JSON text records (processing
    time pinned so the records are reproducible)."""
    root = scratch_path(spark, "stream-topic")
    _stage(sensor_messages(spark, sf_dir), f"{root}/sensor/in")
    _stage(user_messages(spark, sf_dir), f"{root}/user/in")
    for name, flow in (("sensor", SF.sensor_output_records), ("user", SF.user_output_records)):
        src = _stream_of(spark, f"{root}/{name}", name)
        q = SIO.write_stream(flow(src, pinned_now()), f"{root}/out/{name}",
                             f"{root}/checkpoint/{name}",
                             fmt="json")
        SIO.run_until_caught_up(q)
    # Each folder is read by itself: only then does Spark follow the sink's commit log.
    sinks = [spark.read.schema("topic string, key string, value string, event_id long")
             .json(f"{root}/out/{name}") for name in ("sensor", "user")]
    return sinks[0].unionByName(sinks[1])


def _fanned_out(spark, sf_dir, output: str) -> DataFrame:
    """One run of the sensor topology into its three sinks; one of them read back."""
    root = scratch_path(spark, "stream-fanout")
    messages = sensor_messages(spark, sf_dir, varied=True)
    _stage(messages, f"{root}/in")
    SIO.run_until_caught_up(FO.sensor_fan_out(_stream_of(spark, root, "sensor-data"), f"{root}/out"))
    schema = FO.SENSOR_OUTPUTS[output](M.parse_sensor(messages)).schema
    return FO.read_sink(spark, f"{root}/out/{output}", schema)


def q_fanout_anomalies(spark, sf_dir):
    return _fanned_out(spark, sf_dir, "anomalies").drop(*S.PROCESSING_TIME)


def q_fanout_dead_letters(spark, sf_dir):
    return _fanned_out(spark, sf_dir, "dead_letters")


def q_fanout_audit_lines(spark, sf_dir):
    return _fanned_out(spark, sf_dir, "audit_lines")


TOPICS = ["click", "error", "purchase", "signup", "view"]


def q_topic_totals_kept(spark, sf_dir):
    """Messages per topic, counted while two arrivals are read in two runs on
    one checkpoint."""
    root = scratch_path(spark, "stream-totals")
    events = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"]).select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"), "event_id")
    first = F.col("event_id") % 2 == 0
    with KT.kept_totals(spark, f"{root}/totals"):
        for part in (first, ~first):
            _stage(events.where(part), f"{root}/in")
            _run(KT.observed(_stream_of(spark, root, "events"), TOPICS), root)
    return KT.totals(spark, f"{root}/totals")


QUERIES = {
    "fanout_anomalies": q_fanout_anomalies,
    "fanout_dead_letters": q_fanout_dead_letters,
    "fanout_audit_lines": q_fanout_audit_lines,
    "topic_totals_kept": q_topic_totals_kept,
    "stream_source": q_stream_source,
    "stream_sensor": q_stream_sensor,
    "stream_user": q_stream_user,
    "stream_dead_letters": q_stream_dead_letters,
    "stream_resume": q_stream_resume,
    "stream_sink": q_stream_sink,
}
