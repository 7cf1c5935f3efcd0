"""Metric panels evaluated on a time grid.

A panel asks for a value at every step of a grid, not at the samples' own times.
Both evaluations here merge each series' samples with the grid's times in one
ordered sequence (a union, not a join of samples with steps) and look back from
each grid time:

* ``instant_grid`` -- the last sample within the look-back (as-of merge);
* ``rate_grid`` -- the per-second rate of a counter over the trailing window,
  with resets and extrapolation to the window's edges as PromQL's ``rate``
  defines them.

Scale: time is cut into chunks and all windows run per (series, chunk), so a
series of any length is spread over tasks.  A look-back reaches at most ``reach``
into the chunk before; samples that close to a chunk's end are also put into the
next one as context.  Grid times are made per (series, chunk) that holds samples,
so a series costs nothing where it is silent.  Two shuffles: the samples' (series,
chunk) pairs and the merged sequence.  The number of their tasks follows from the
number of samples, so the memory of one stays the same.

Samples without a value (NULL or NaN) are no samples.  Of samples of one series
at the same time the one with the largest value counts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.metrics import MICROS, _by_series, epoch_micros, label
from vigilo.operators.split import window_parts

SERIES = ["metric", "series", "chunk"]


def _merged(df: DataFrame, start_us: int, end_us: int, step_us: int, reach_us: int, chunk_reaches: int) -> DataFrame:
    """Samples and grid times as rows ``(metric, series, labels, chunk, t_us,
    value, at_step)``; ``value`` is NULL on grid rows, ``labels`` on samples'."""
    chunk_us = chunk_reaches * reach_us
    samples = (_by_series(df).where(F.col("value").isNotNull() & ~F.isnan("value"))
               .select("metric", "series", "labels", epoch_micros(F.col("ts")).alias("t_us"), F.col("value").cast("double").alias("value"))
               .where((F.col("t_us") > start_us - reach_us) & (F.col("t_us") <= end_us)))
    own = F.floor(F.col("t_us") / F.lit(chunk_us)).cast("long")
    late = F.col("t_us") > (own + 1) * F.lit(chunk_us) - F.lit(reach_us)
    samples = samples.withColumn("chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    first = F.greatest(F.lit(start_us), F.lit(start_us) + F.ceil((F.col("chunk") * chunk_us - start_us) / F.lit(step_us)) * step_us)
    last = F.least(F.lit(end_us), (F.col("chunk") + 1) * chunk_us - 1)
    # Each sample makes up to two rows and a grid time or more.
    tasks = window_parts(df.sparkSession, 3 * df.count())
    pairs = samples.select(*SERIES, "labels").repartition(tasks, "series", "chunk").groupBy(*SERIES).agg(F.any_value("labels").alias("labels"))
    steps = (pairs.withColumns({"first": first, "last": last}).where("first <= last")
             .select(*SERIES, "labels", F.explode(F.sequence("first", "last", F.lit(step_us))).alias("t_us"))
             .select(*SERIES, "labels", "t_us", F.lit(None).cast("double").alias("value"), F.lit(True).alias("at_step")))
    rows = samples.select(*SERIES, F.lit(None).cast(df.schema["labels"].dataType).alias("labels"), "t_us", "value",
                          F.lit(False).alias("at_step"))
    return rows.unionByName(steps).repartition(tasks, *SERIES)


def _time(t_us: Column) -> Column:
    """Microseconds as a timestamp without time zone."""
    return F.timestamp_add("MICROSECOND", t_us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def instant_grid(df: DataFrame, start_us: int, end_us: int, step_us: int, lookback_us: int, chunk_reaches: int = 8) -> DataFrame:
    """``(metric, series, labels, ts, value)``: each series' last sample in
    ``(t - lookback, t]`` for every grid time ``t`` that has one."""
    rows = _merged(df, start_us, end_us, step_us, lookback_us, chunk_reaches)
    # A sample at a grid time comes before it; one running value, no frame.
    upto = Window.partitionBy(*SERIES).orderBy("t_us", "at_step", "value").rowsBetween(Window.unboundedPreceding, 0)
    sample = F.when(~F.col("at_step"), F.struct("t_us", "value"))
    seen = rows.withColumn("last", F.last(sample, ignorenulls=True).over(upto)).where("at_step")
    return (seen.where(F.col("last.t_us") > F.col("t_us") - lookback_us)
            .select("metric", "series", "labels", _time(F.col("t_us")).alias("ts"), F.col("last.value").alias("value")))


def sum_by_step(vectors: DataFrame, by: list[str]) -> DataFrame:
    """``sum by (labels...)`` at every grid time."""
    return vectors.groupBy("ts", *[label(b).alias(b) for b in by]).agg(F.sum("value").alias("value"))


def rate_grid(df: DataFrame, start_us: int, end_us: int, step_us: int, window_us: int, chunk_reaches: int = 8) -> DataFrame:
    """``(metric, series, labels, ts, rate)`` for every grid time ``t`` with two
    samples or more in ``(t - w, t]``.

    The increase is last minus first value plus what each reset took away.  It
    is extended to each edge of the window: by the distance to the edge, or by
    half the mean distance of samples where the edge is further off than 1.1 of
    that; towards the start at most to where the counter would have been zero.
    """
    rows = _merged(df, start_us, end_us, step_us, window_us, chunk_reaches)
    sample = ~F.col("at_step")
    ordered = Window.partitionBy(*SERIES).orderBy("t_us", "at_step", "value")
    before = F.last("value", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("lost", F.when(sample, F.when(F.col("value") < before, before).otherwise(0.0)))
    frame = Window.partitionBy(*SERIES).orderBy("t_us").rangeBetween(-(window_us - 1), 0)
    point = F.when(sample, F.struct("t_us", "value", "lost"))
    seen = rows.select(
        *SERIES, "labels", "t_us", "at_step",
        F.count("value").over(frame).alias("n"), F.sum("lost").over(frame).alias("lost"),
        F.min(point).over(frame).alias("first"), F.max(point).over(frame).alias("last")).where("at_step AND n >= 2")
    seconds = lambda c: c / F.lit(float(MICROS))
    seen = seen.withColumns({
        # The first sample's own reset happened before the window.
        "increase": F.col("last.value") - F.col("first.value") + F.col("lost") - F.col("first.lost"),
        "sampled": seconds(F.col("last.t_us") - F.col("first.t_us")),
        "to_start": seconds(F.col("first.t_us") - (F.col("t_us") - window_us)),
        "to_end": seconds(F.col("t_us") - F.col("last.t_us")),
    }).where("sampled > 0").withColumn("mean", F.col("sampled") / (F.col("n") - 1))
    edge = lambda c: F.when(F.col(c) >= 1.1 * F.col("mean"), F.col("mean") / 2).otherwise(F.col(c))
    zero = F.when((F.col("increase") > 0) & (F.col("first.value") >= 0), F.col("sampled") * (F.col("first.value") / F.col("increase")))
    reached = F.col("sampled") + F.least(edge("to_start"), zero) + edge("to_end")
    rate = F.col("increase") * (reached / F.col("sampled")) / (window_us / MICROS)
    return seen.select("metric", "series", "labels", _time(F.col("t_us")).alias("ts"), rate.alias("rate"))
