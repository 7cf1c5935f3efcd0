"""Metric samples ``(metric, labels, ts, value)`` bound to ``events``.

* counter ``requests_total``: running sum of ``value`` per (user, event
  type, day), ordered by (ts, event_id) -- it resets every day;
* gauge ``events_value``: the raw ``value``.

* counters ``cpu_seconds_total`` and ``transmit_bytes_total``, gauge
  ``memory_bytes``: the same numbers in the units of their panels.

Labels: ``pod = 'pod-' || user_id``, ``namespace = event_type``, ``phase``
by event type, ``container`` is ``POD`` for every fifth user.  The running sum is computed per (series, day) by key-range buckets
(:func:`vigilo.operators.split.running_total`), so no task holds a whole
series-day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators.metrics import epoch_micros
from vigilo.operators.split import running_total
from vigilo.sources.tables import read_table, written_once

COUNTER = "requests_total"
GAUGE = "events_value"


CPU, TRANSMIT, MEMORY = "cpu_seconds_total", "transmit_bytes_total", "memory_bytes"
SCALE = {COUNTER: 1, GAUGE: 1, CPU: 500, TRANSMIT: 2, MEMORY: 10_000_000}
PHASES = {"view": "Running", "click": "Pending", "error": "Failed", "purchase": "Succeeded"}


def _labels():
    phase = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in PHASES.items()], F.lit("Unknown"))
    return F.create_map(F.lit("pod"), F.concat(F.lit("pod-"), F.col("user_id").cast("string")),
                        F.lit("namespace"), F.col("event_type"),
                        F.lit("phase"), phase,
                        F.lit("container"), F.when(F.col("user_id") % 5 == 0, "POD").otherwise("app"))


def metric_samples(spark: SparkSession, sf_dir: str, name: str = COUNTER) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type",
                                                  "value"])
    value = F.col("value")
    if name in (COUNTER, CPU, TRANSMIT):
        # Running sum per (user, type, day), computed by key-range buckets so
        # one busy series-day is still spread over many tasks.
        # The sums are the metric store's content: written once per application.
        events = written_once(spark, sf_dir, ["events"], "counters", lambda: running_total(
            events.withColumn("day", F.to_date("ts")).withColumn("t_us", epoch_micros(F.col("ts"))),
            ["user_id", "event_type", "day"], ["t_us", "event_id"], F.col("value"), "counter"))
        value = F.col("counter")
    return events.select(F.lit(name).alias("metric"), _labels().alias("labels"),
                         F.col("ts"), (value * SCALE[name]).alias("value"))
