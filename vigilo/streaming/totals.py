"""Message totals kept while a topic is read.

The counts of every micro-batch are observed on the stream itself (named
metrics, computed by the tasks that read the records) and come with the
progress event of the batch.  A listener writes them as one small record for
each (query, batch id).  What a batch holds is fixed by the query's offset log,
so its first record stands and a replay adds nothing; the totals of several runs
on one checkpoint are the sum over the records, the topic is never read again.
A driver that ends after a batch's commit and before its event leaves that
batch without a record: ``unrecorded`` names such batches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vigilo.sources import lake as L

METRIC = "topic_totals"
OTHER = "_other"


def observed(stream: DataFrame, topics: list[str], name: str = METRIC) -> DataFrame:
    """``stream`` with one observed count a topic (and one for all others)."""
    known = F.col("topic").isin(topics) if topics else F.lit(False)
    return stream.observe(name, *[F.count_if(F.col("topic") == t).alias(t) for t in topics],
                          F.count_if(~F.coalesce(known, F.lit(False))).alias(OTHER))


class TotalsListener(StreamingQueryListener):
    """Writes the observed counts of each micro-batch below ``path``."""

    def __init__(self, spark: SparkSession, path: str, name: str = METRIC) -> None:
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(self.name)
        if counts is None:
            return
        record = {"query": str(progress.id), "batch": progress.batchId, "counts": counts.asDict()}
        L.put_text(self.spark, f"{self.path}/{progress.id}-{progress.batchId}.json", json.dumps(record))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class kept_totals:
    """``with kept_totals(spark, path): run the stream``: on leaving, the records
    of all finished batches are written."""

    def __init__(self, spark: SparkSession, path: str, name: str = METRIC) -> None:
        self.spark, self.listener = spark, TotalsListener(spark, path, name)

    def __enter__(self) -> TotalsListener:
        self.spark.streams.addListener(self.listener)
        return self.listener

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(600_000)
        self.spark.streams.removeListener(self.listener)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, messages)`` over all runs: a sum over one record a batch."""
    rows = spark.read.schema("query string, batch long, counts map<string, long>").json(path)
    return (rows.select(F.explode("counts").alias("topic", "n")).groupBy("topic").agg(F.sum("n").alias("messages"))
            .where((F.col("topic") != OTHER) | (F.col("messages") > 0)))


def unrecorded(spark: SparkSession, path: str, checkpoint: str) -> list[int]:
    """Batches that the query with this checkpoint committed and no record counts."""
    committed = {int(n) for n, _ in L.dataset_names(spark, f"{checkpoint}/commits") if n.isdigit()}
    query = json.loads(L.get_text(spark, f"{checkpoint}/metadata"))["id"]
    return sorted(b for b in committed if not L.exists(spark, f"{path}/{query}-{b}.json"))
