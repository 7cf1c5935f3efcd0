"""One read, several sinks; replayed batches; totals kept while reading."""

import pytest
from pyspark.sql import functions as F

from vigilo.operators import messages as M
from vigilo.plans import scoring_queries
from vigilo.session import scratch_path
from vigilo.sources import lake as L
from vigilo.sources.messages import sensor_messages
from vigilo.streaming import fanout as FO
from vigilo.streaming import io as SIO
from vigilo.streaming import totals as KT

from paths import SF_SMALL


@pytest.fixture()
def topic(spark):
    root = scratch_path(spark, "fanout-test")
    messages = sensor_messages(spark, SF_SMALL, varied=True)
    messages.repartition(4).write.parquet(f"{root}/in")
    return root, messages


def _stream(spark, root, files="1"):
    return SIO.read_topic_stream(spark, "sensor-data", fmt="parquet", path=f"{root}/in", options={"maxFilesPerTrigger": files})


def _read(spark, root, messages, name):
    schema = FO.SENSOR_OUTPUTS[name](M.parse_sensor(messages)).schema
    return FO.read_sink(spark, f"{root}/out/{name}", schema)


def _counts(spark, root, messages):
    return {n: sorted(r["event_id"] for r in _read(spark, root, messages, n).collect()) for n in FO.SENSOR_OUTPUTS}


def _expected(spark):
    return {"anomalies": sorted(r["event_id"] for r in scoring_queries.q_varied_anomalies(spark, SF_SMALL).collect()),
            "dead_letters": sorted(r["event_id"] for r in scoring_queries.q_dead_letters(spark, SF_SMALL).collect()),
            "audit_lines": sorted(r["event_id"] for r in scoring_queries.q_sensor_parse(spark, SF_SMALL).where("parse_ok").collect())}


def test_each_message_is_read_once_for_all_sinks(spark, topic):
    root, messages = topic
    query = FO.sensor_fan_out(_stream(spark, root), f"{root}/out")
    SIO.run_until_caught_up(query)
    # Spark counts a source row each time a job of the batch reads it.
    assert sum(p["numInputRows"] for p in query.recentProgress) == messages.count()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert _counts(spark, root, messages) == _expected(spark)


def test_a_stop_between_write_and_ledger_repeats_nothing(spark, topic, monkeypatch):
    root, messages = topic
    put, left = L.put_text, [4]

    def stops(*args, **how):
        """The rows of the second batch's first sink are written, its record is not."""
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("the driver stops here")
        return put(*args, **how)

    monkeypatch.setattr(L, "put_text", stops)
    with pytest.raises(Exception, match="stops here"):
        SIO.run_until_caught_up(FO.sensor_fan_out(_stream(spark, root), f"{root}/out"))
    monkeypatch.undo()
    assert L.exists(spark, f"{root}/out/anomalies/query=sensor/batch=1")
    seen = _counts(spark, root, messages)["anomalies"]
    assert len(seen) == len(set(seen)) < len(_expected(spark)["anomalies"])  # the unrecorded batch is not read
    SIO.run_until_caught_up(FO.sensor_fan_out(_stream(spark, root), f"{root}/out"))
    assert _counts(spark, root, messages) == _expected(spark)


def test_a_stop_between_ledger_and_commit_repeats_nothing(spark, topic):
    root, messages = topic
    SIO.run_until_caught_up(FO.sensor_fan_out(_stream(spark, root), f"{root}/out"))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out/_checkpoint-sensor/commits")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    assert fs.delete(newest, False)
    query = FO.sensor_fan_out(_stream(spark, root), f"{root}/out")
    SIO.run_until_caught_up(query)
    assert _counts(spark, root, messages) == _expected(spark)


def test_empty_topic(spark):
    root = scratch_path(spark, "fanout-empty")
    messages = sensor_messages(spark, SF_SMALL).where("event_id < 0")
    messages.write.parquet(f"{root}/in")
    SIO.run_until_caught_up(FO.sensor_fan_out(_stream(spark, root), f"{root}/out"))
    assert _counts(spark, root, messages) == {n: [] for n in FO.SENSOR_OUTPUTS}


def test_totals_of_two_runs_and_a_replayed_batch(spark):
    root = scratch_path(spark, "totals-test")
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "new").when(F.col("id") % 11 == 0, None)
                                    .otherwise("b").alias("topic"), F.lit("k").alias("key"), F.lit("v").alias("value"), F.col("id").alias("event_id"))
    want = {r["topic"]: r["count"] for r in rows.groupBy(F.when(F.col("topic").isin("a", "b"), F.col("topic")).otherwise(KT.OTHER).alias("topic")).count().collect()}

    def run():
        stream = KT.observed(SIO.read_topic_stream(spark, "t", fmt="parquet", path=f"{root}/in", options={"maxFilesPerTrigger": "1"}), ["a", "b", "c"])
        with KT.kept_totals(spark, f"{root}/totals"):
            SIO.run_until_caught_up(SIO.write_stream(stream, f"{root}/sink", f"{root}/ckpt"))
        return {r["topic"]: r["messages"] for r in KT.totals(spark, f"{root}/totals").collect()}

    rows.where("id < 500").repartition(2).write.parquet(f"{root}/in")
    run()
    rows.where("id >= 500").repartition(3).write.mode("append").parquet(f"{root}/in")
    assert run() == {**want, "c": 0}
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ckpt/commits")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    assert fs.delete(newest, False)
    assert run() == {**want, "c": 0}
    assert KT.unrecorded(spark, f"{root}/totals", f"{root}/ckpt") == []
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(max(p for n, p in L.dataset_names(spark, f"{root}/totals") if "-0." in n)), False)
    assert KT.unrecorded(spark, f"{root}/totals", f"{root}/ckpt") == [0]
