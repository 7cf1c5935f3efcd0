"""Named queries for the dashboard metric operators.

Events are sparse per series (a few per day), so the registered checks use
windows of days where the dashboard uses minutes; the operators take the
span as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators import grids as GR
from vigilo.operators import metrics as MT
from vigilo.sources.metrics import COUNTER, CPU, GAUGE, MEMORY, TRANSMIT, metric_samples
from vigilo.sources.tables import read_table

SELECTOR = [("namespace", "=", "view"), ("pod", "=~", "pod-1.*"), ("container", "!=", "POD")]
RATE_SELECTOR = [("pod", "=~", "pod-.*"), ("container", "!=", "POD")]
RATE_WINDOW_S = 6 * 86400
# Fixed values of the dashboard panels.
REPLICA_STEPS = [(5.0, "yellow"), (8.0, "red")]
PHASE_TEXT = {"Running": "Running", "Pending": "Pending", "Failed": "Failed",
              "Succeeded": "Succeeded"}
CPU_TARGET, MEMORY_TARGET = 0.1, 358400000.0
CPU_STEPS, MEMORY_STEPS = [(CPU_TARGET, "red")], [(MEMORY_TARGET, "red")]
REFERENCE_LINE = 5.0


def _flat(df: DataFrame, value: str = "value", digits: int | None = 6) -> DataFrame:
    v = F.round(value, digits) if digits is not None else F.col(value)
    return df.select(MT.label("pod").alias("pod"), MT.label("namespace").alias("namespace"),
                     "ts", v.alias(value))


def q_metric_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = MT.select_series(metric_samples(spark, sf_dir, GAUGE), GAUGE, SELECTOR)
    return _flat(df)


def q_metric_range(spark, sf_dir):
    gauge = metric_samples(spark, sf_dir, GAUGE)
    return _flat(MT.time_range(gauge, MT.latest_ts(gauge), "1 day"))


def q_metric_sum_by(spark, sf_dir):
    gauge = MT.select_series(metric_samples(spark, sf_dir, GAUGE), GAUGE,
                             [("pod", "=~", "pod-.*")])
    vector = MT.instant_vector(gauge, MT.latest_ts(gauge), lookback="1 day")
    return MT.sum_by(vector, ["phase"])


def _rate(spark, sf_dir, name: str, legend: str) -> DataFrame:
    counter = MT.select_series(metric_samples(spark, sf_dir, name), name, RATE_SELECTOR)
    r = MT.rate(counter, RATE_WINDOW_S, chunk_windows=2)
    return r.select(MT.label("pod").alias("pod"), MT.label("namespace").alias("namespace"), "ts",
                    MT.series_name(legend).alias("name"), F.round("rate", 6).alias("rate"))


def q_metric_rate(spark, sf_dir):
    return _rate(spark, sf_dir, COUNTER, "{{pod}} - RX")


def q_metric_tx(spark, sf_dir):
    return _rate(spark, sf_dir, TRANSMIT, "{{pod}} - TX")


def _panel(samples: DataFrame, target: float, title: str, steps) -> DataFrame:
    """The samples of a panel with their colours, and its target series."""
    reference = MT.reference_series(samples, target).withColumns(
        {"pod": F.lit(None).cast("string"), "namespace": F.lit(None).cast("string")})
    both = MT.overlay([("sample", samples), (title, reference.select(samples.columns))])
    return both.withColumn("color", MT.threshold_class(F.col("value"), steps))


def q_metric_cpu(spark, sf_dir):
    r = _rate(spark, sf_dir, CPU, "{{pod}}")
    samples = r.select("pod", "namespace", "ts", F.col("rate").alias("value"))
    return _panel(samples, CPU_TARGET, "CPU Target", CPU_STEPS)


def q_metric_memory(spark, sf_dir):
    gauge = MT.select_series(metric_samples(spark, sf_dir, MEMORY), MEMORY, RATE_SELECTOR)
    return _panel(_flat(gauge, digits=3), MEMORY_TARGET, "Memory Target", MEMORY_STEPS)


def q_metric_last(spark, sf_dir):
    return _flat(MT.last_not_null(metric_samples(spark, sf_dir, GAUGE)))


def q_metric_thresholds(spark, sf_dir):
    last = MT.last_not_null(metric_samples(spark, sf_dir, GAUGE))
    v = F.col("value")
    return last.select(
        MT.label("pod").alias("pod"), MT.label("namespace").alias("namespace"), "value",
        MT.threshold_class(v, REPLICA_STEPS).alias("color"),
        MT.map_values(MT.label("phase"), PHASE_TEXT).alias("phase_text"),
        F.lit(REFERENCE_LINE).alias("target"), (v > F.lit(REFERENCE_LINE)).alias("above_target"))


def q_metric_overlay(spark, sf_dir):
    gauge = metric_samples(spark, sf_dir, GAUGE)
    panels = [("Current Replicas", MT.select_series(gauge, GAUGE, [("namespace", "=", "view")])),
              ("Desired Replicas", MT.select_series(gauge, GAUGE, [("namespace", "=", "click")])),
              ("Max Replicas", MT.select_series(gauge, GAUGE, [("namespace", "=", "signup")]))]
    return MT.overlay([(name, _flat(df)) for name, df in panels])


# The grid of the stepped panels: every twelve hours over the samples' days.
STEP_US, GRID_WINDOW_US, LOOKBACK_US = 43_200_000_000, RATE_WINDOW_S * 1_000_000, 86_400_000_000


def _grid(samples: DataFrame) -> tuple[int, int]:
    """First and last grid time: whole steps around the samples' time range."""
    span = samples.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        *[MT.epoch_micros(F.col(c)).alias(c) for c in ("lo", "hi")]).first()
    if span["lo"] is None:
        return 0, 0
    return span["lo"] // STEP_US * STEP_US, -(-span["hi"] // STEP_US) * STEP_US


def q_metric_rate_grid(spark, sf_dir):
    """``rate`` of a counter panel at every step."""
    events = read_table(spark, sf_dir, "events", ["ts"])
    counter = MT.select_series(metric_samples(spark, sf_dir, COUNTER), COUNTER, RATE_SELECTOR)
    r = GR.rate_grid(counter, *_grid(events), STEP_US, GRID_WINDOW_US, chunk_reaches=1)
    return r.select(MT.label("pod").alias("pod"), MT.label("namespace").alias("namespace"), "ts",
                    MT.series_name("{{pod}} - RX").alias("name"), F.round("rate", 12).alias("rate"))


def q_metric_instant_grid(spark, sf_dir):
    """Each gauge's current value at every step."""
    gauge = MT.select_series(metric_samples(spark, sf_dir, GAUGE), GAUGE, [("pod", "=~", "pod-1.*")])
    return _flat(GR.instant_grid(gauge, *_grid(read_table(spark, sf_dir, "events", ["ts"])), STEP_US, LOOKBACK_US))


def q_metric_sum_by_step(spark, sf_dir):
    """``sum by (phase)`` of the current values at every step."""
    gauge = MT.select_series(metric_samples(spark, sf_dir, GAUGE), GAUGE, [("pod", "=~", "pod-.*")])
    vectors = GR.instant_grid(gauge, *_grid(read_table(spark, sf_dir, "events", ["ts"])), STEP_US, LOOKBACK_US)
    return GR.sum_by_step(vectors, ["phase"]).withColumn("value", F.round("value", 6))


QUERIES = {
    "metric_rate_grid": q_metric_rate_grid,
    "metric_instant_grid": q_metric_instant_grid,
    "metric_sum_by_step": q_metric_sum_by_step,
    "metric_select": q_metric_select,
    "metric_range": q_metric_range,
    "metric_sum_by": q_metric_sum_by,
    "metric_rate": q_metric_rate,
    "metric_tx": q_metric_tx,
    "metric_cpu": q_metric_cpu,
    "metric_memory": q_metric_memory,
    "metric_last": q_metric_last,
    "metric_thresholds": q_metric_thresholds,
    "metric_overlay": q_metric_overlay,
}
