"""Lake I/O helpers and the stream = batch / restart properties."""

from pyspark.sql import functions as F

from vigilo.operators import scoring as S
from vigilo.plans import scoring_queries
from vigilo.session import scratch_path
from vigilo.sources import lake as L
from vigilo.sources.messages import sensor_messages
from vigilo.streaming import io as SIO
from vigilo.streaming import scoring as SF

from paths import SF_SMALL


def test_read_csv_or_none_falls_back(spark):
    assert L.read_csv_or_none(spark, scratch_path(spark, "missing") + "/nothing.csv") is None


def test_latest_dataset_and_ingest_if_absent(spark):
    root = scratch_path(spark, "lake-test")
    a = spark.range(5).withColumn("x", F.lit("old"))
    b = spark.range(3).withColumn("x", F.lit("new"))
    L.write_csv(a, f"{root}/large_food_dataset_20240101-000000.csv")
    L.write_csv(b, f"{root}/large_food_dataset_latest.csv")
    L.write_csv(a, f"{root}/other.csv")
    got = L.latest_dataset(spark, root, "id long, x string", "large_food_dataset").collect()
    assert sorted(r["x"] for r in got) == ["new"] * 3
    target = f"{root}/ingest.csv"
    L.write_if_absent(b, target)
    L.write_if_absent(a, target)
    assert L.read_csv(spark, target, "id long, x string").count() == 3


def test_versioned_write_and_verify(spark):
    root = scratch_path(spark, "versions")
    df = spark.range(10)
    v = L.versioned_write(spark, df, root, "20240101-000000")
    L.versioned_write(spark, spark.range(4), root, "20240202-000000")
    assert spark.read.parquet(v).count() == 10
    assert L.read_latest(spark, root, df.schema).count() == 4
    row = L.verify_write(spark, df, f"{root}/verify").first()
    assert row["verified"] and row["rows_read"] == 10


def test_fallback_only_for_missing_or_short_data(spark):
    path = scratch_path(spark, "fallback-test") + "/x.csv"
    schema = spark.range(1).schema
    assert L.read_or_fallback(spark, path, schema, 5, spark.range(3)).count() == 3     # missing
    assert L.read_or_fallback(spark, path, schema, 5, spark.range(8)).count() == 8     # too short
    assert L.read_or_fallback(spark, path, schema, 5, spark.range(1)).count() == 8     # long enough


def test_replay_after_a_lost_commit(spark):
    """A run that fails after writing a batch but before committing it writes
    the batch again; the file sink's log keeps every record once."""
    root = scratch_path(spark, "replay-test")
    sensor_messages(spark, SF_SMALL).repartition(3).write.parquet(f"{root}/in")

    def run():
        src = SIO.read_topic_stream(spark, "sensor-data", fmt="parquet", path=f"{root}/in", options={"maxFilesPerTrigger": "1"})
        SIO.run_until_caught_up(SIO.write_stream(SF.sensor_flow(src), f"{root}/sink", f"{root}/ckpt"))
        return spark.read.parquet(f"{root}/sink").count()

    first = run()
    fs, where = L._folder(spark, f"{root}/ckpt/commits")
    newest = max(str(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())
    assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(where, newest), False)
    assert run() == first == scoring_queries.q_sensor_anomalies(spark, SF_SMALL).count()


def test_stream_equals_batch_and_resumes(spark):
    root = scratch_path(spark, "stream-test")
    msgs = sensor_messages(spark, SF_SMALL)
    first = F.col("event_id") < 500
    msgs.where(first).repartition(2).write.parquet(f"{root}/in")
    src = lambda: SIO.read_topic_stream(spark, "sensor-data", fmt="parquet", path=f"{root}/in",
                                        options={"maxFilesPerTrigger": "1"})
    q = SIO.write_stream(SF.sensor_flow(src()), f"{root}/sink", f"{root}/ckpt")
    SIO.run_until_caught_up(q)
    n1 = spark.read.parquet(f"{root}/sink").count()
    msgs.where(~first).repartition(2).write.mode("append").parquet(f"{root}/in")
    q = SIO.write_stream(SF.sensor_flow(src()), f"{root}/sink", f"{root}/ckpt")
    SIO.run_until_caught_up(q)
    streamed = spark.read.parquet(f"{root}/sink").drop(*S.PROCESSING_TIME)
    batch = scoring_queries.q_sensor_anomalies(spark, SF_SMALL)
    assert 0 < n1 < streamed.count()
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
