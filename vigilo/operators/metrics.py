"""Metric-series operators: selectors, instant aggregation, counter rate,
reductions, thresholds and panel overlays.

Samples are ``(metric, labels map<string,string>, ts, value)``; a series
is one (metric, labels) pair.  Everything is DataFrame code: selectors are
filters (pushed to the scan where possible), instant and reduction queries
are aggregations with map-side partial aggregation, and ``rate`` uses
windows over bounded (series, time-chunk) groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, independent of the
    session time zone for TIMESTAMP_NTZ input."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def label(name: str) -> Column:
    """A label's value; a missing label reads as empty text."""
    return F.coalesce(F.col("labels")[name], F.lit(""))


def series_key() -> Column:
    """Canonical text of the label set (maps cannot be grouped or joined
    on): label entries sorted by name, as JSON."""
    return F.to_json(F.sort_array(F.map_entries(F.col("labels"))))


def _by_series(df: DataFrame) -> DataFrame:
    return df if "series" in df.columns else df.withColumn("series", series_key())


def matcher(name: str, op: str, value: str) -> Column:
    """One label matcher: ``=``, ``!=``, ``=~`` / ``!~`` (anchored regex)."""
    v = label(name)
    if op == "=":
        return v == F.lit(value)
    if op == "!=":
        return v != F.lit(value)
    if op in ("=~", "!~"):
        hit = v.rlike(f"^(?:{value})$")
        return hit if op == "=~" else ~hit
    raise ValueError(f"unknown matcher {op!r}")


def select_series(df: DataFrame, metric: str | None,
                  matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    cond = F.lit(True) if metric is None else (F.col("metric") == metric)
    for name, op, value in matchers:
        cond = cond & matcher(name, op, value)
    return df.where(cond)


def time_range(df: DataFrame, end: Column, span: str) -> DataFrame:
    """Samples with ``end - span < ts <= end``."""
    return df.where((F.col("ts") > end - F.expr(f"INTERVAL {span}")) & (F.col("ts") <= end))


def latest_ts(df: DataFrame) -> Column:
    """The newest sample time, resolved first (one aggregation over the
    ``ts`` column) and used as a literal, so both bounds of a time range
    reach the parquet scan as pushed filters (row groups and files outside
    the range are skipped)."""
    end = df.agg(F.max("ts").alias("end")).first()["end"]
    dtype = dict(df.dtypes)["ts"]
    if end is None:
        return F.lit(None).cast(dtype)
    if dtype == "timestamp_ntz":
        # From text: a Python datetime literal would pass through the
        # driver process's local zone.
        return F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(end).cast(dtype)


def instant_vector(df: DataFrame, at: Column, lookback: str = "5 minutes") -> DataFrame:
    """Latest sample per series at or before ``at`` within ``lookback``."""
    window = _by_series(time_range(df, at, lookback))
    return window.groupBy("metric", "series").agg(
        F.any_value("labels").alias("labels"),
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def sum_by(vector: DataFrame, by: list[str], digits: int | None = 6) -> DataFrame:
    """``sum by (labels...)`` over an instant vector."""
    total = F.sum("value")
    total = F.round(total, digits) if digits is not None else total
    return vector.groupBy(*[label(b).alias(b) for b in by]).agg(total.alias("value"))


def last_not_null(df: DataFrame) -> DataFrame:
    """The "last not null" reduction per series."""
    return _by_series(df).where(F.col("value").isNotNull() & ~F.isnan("value")) \
        .groupBy("metric", "series").agg(F.any_value("labels").alias("labels"),
                                         F.max_by("value", F.struct("ts", "value")).alias("value"),
                                         F.max("ts").alias("ts"))


def rate(df: DataFrame, window_seconds: int, chunk_windows: int = 8) -> DataFrame:
    """Per-second rate of a counter over the trailing window ``(t-w, t]``.

    For every sample ``t`` of a series with at least two samples in its
    window: increase = sum of reset-corrected steps of the samples in the
    window except the first (``v - prev``, or ``v`` when the counter went
    down), divided by ``t - first_ts`` in seconds.  No extrapolation to
    the window edges is done.

    Scale: a series may be arbitrarily long (even a third of all rows), so
    no window is partitioned by series alone.  Time is cut into chunks of
    ``chunk_windows * w`` and all windows run per (series, chunk).  A step
    is only ever used when its predecessor lies in the same window, i.e.
    less than ``w`` earlier, and a window reaches at most ``w`` into the
    previous chunk.  So each sample within ``w`` of its chunk's end is
    also emitted (one ``explode``) into the next chunk as a context row:
    it supplies predecessors and window members there but is not output.
    Lag and range frame share one partitioning, so the whole operator is a
    single shuffle with no join and no second pass over the input.
    """
    w_us = window_seconds * MICROS
    chunk_us = chunk_windows * w_us
    s = _by_series(df).select("metric", "series", "labels", "ts", "value",
                              epoch_micros(F.col("ts")).alias("t_us"))
    own_chunk = F.floor(F.col("t_us") / F.lit(chunk_us)).cast("long")
    near_end = F.col("t_us") > (own_chunk + 1) * F.lit(chunk_us) - F.lit(w_us)
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (s.withColumn("__copy", F.explode(copies))
            .withColumn("chunk", own_chunk + F.col("__copy"))
            .withColumn("context", F.col("__copy") == 1).drop("__copy"))
    series = ["metric", "series", "chunk"]
    ordered = Window.partitionBy(*series).orderBy("t_us")
    # Samples at the same time come in the order of their values.
    prev = F.lag("value").over(Window.partitionBy(*series).orderBy("t_us", "value"))
    step = F.when(prev.isNull(), F.lit(None).cast("double")) \
        .when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
    rows = rows.withColumn("step", step)
    frame = ordered.rangeBetween(-(w_us - 1), 0)
    out = rows.select(
        "metric", "series", "labels", "ts", "t_us", "context",
        F.count(F.lit(1)).over(frame).alias("n"),
        F.sum("step").over(frame).alias("steps"),
        F.first("step").over(frame).alias("first_step"),
        F.min("t_us").over(frame).alias("first_us"),
    ).where(~F.col("context") & (F.col("n") >= 2))
    increase = F.col("steps") - F.coalesce(F.col("first_step"), F.lit(0.0))
    seconds = (F.col("t_us") - F.col("first_us")) / F.lit(float(MICROS))
    return out.select("metric", "series", "labels", "ts", (increase / seconds).alias("rate"))


def reference_series(df: DataFrame, value: float) -> DataFrame:
    """A constant series: ``value`` at every sample time of ``df``."""
    return df.select("ts").distinct().withColumn("value", F.lit(float(value)))


def series_name(template: str) -> Column:
    """Legend text from a ``{{label}}`` template, e.g. ``{{pod}} - RX``."""
    import re
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    cols = [F.lit(p) if i % 2 == 0 else label(p) for i, p in enumerate(parts) if p != ""]
    return F.concat(*cols) if cols else F.lit("")


def threshold_class(value: Column, steps: list[tuple[float, str]], base: str = "green") -> Column:
    """Colour of a value: the last step whose bound it reaches."""
    expr = None
    for bound, name in sorted(steps, reverse=True):
        expr = (F.when(value >= bound, F.lit(name)) if expr is None
                else expr.when(value >= bound, F.lit(name)))
    return F.lit(base) if expr is None else expr.otherwise(F.lit(base))


def map_values(value: Column, mapping: dict[str, str]) -> Column:
    """Value-to-text mapping with the value itself as fallback."""
    if not mapping:
        return value.cast("string")
    entries = []
    for k, v in mapping.items():
        entries += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*entries)[value.cast("string")], value.cast("string"))


def overlay(panels: list[tuple[str, DataFrame]]) -> DataFrame:
    """Several series in one panel, tagged by a ``series`` column."""
    out = None
    for name, df in panels:
        tagged = df.withColumn("series", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
