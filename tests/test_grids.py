"""Grid evaluation against brute force: gaps, resets, late starts, chunk borders."""

import random

import pytest
from pyspark.sql import functions as F

from vigilo.operators import grids as GR
from vigilo.operators import metrics as MT
from vigilo.operators import split as SP

S = 1_000_000


def _samples(spark, rows):
    df = spark.createDataFrame(rows, "pod string, t long, value double")
    return df.select(F.lit("m").alias("metric"), F.create_map(F.lit("pod"), F.col("pod")).alias("labels"),
                     GR._time(F.col("t")).alias("ts"), "value")


def _data(seed):
    rnd = random.Random(seed)
    rows = []
    for pod, start, every, n in (("hot", 0, 15, 900), ("late", 7000, 15, 200), ("sparse", 100, 700, 18), ("gap", 0, 15, 60), ("gap", 9000, 15, 60), ("one", 4000, 15, 1)):
        v = rnd.choice([0.0, 50.0, 4000.0])
        for i in range(n):
            v = rnd.choice([0.0, 2.0]) if rnd.random() < 0.02 else v + rnd.choice([0, 1, 5, 9])
            rows.append((pod, (start + i * every) * S + rnd.randint(0, 3 * S), v))
    rows += [("hot", 5000 * S, None), ("hot", 5001 * S, float("nan")), ("tie", 100 * S, 5.0), ("tie", 100 * S, 7.0), ("tie", 160 * S, 9.0)]
    return rows


def _series(rows):
    out = {}
    for pod, t, v in rows:
        if v is not None and v == v:
            out.setdefault(pod, []).append((t, v))
    return {p: sorted(x) for p, x in out.items()}


def brute_rate(rows, grid, w):
    out = {}
    for pod, all_ in _series(rows).items():
        lost = [0.0] + [p if v < p else 0.0 for (_, p), (_, v) in zip(all_, all_[1:], strict=False)]
        for t in grid:
            at = [i for i, (x, _) in enumerate(all_) if t - w < x <= t]
            if len(at) < 2 or all_[at[0]][0] == all_[at[-1]][0]:
                continue
            (a, first), (z, last) = all_[at[0]], all_[at[-1]]
            inc = last - first + sum(lost[i] for i in at[1:])
            sampled = (z - a) / S
            mean = sampled / (len(at) - 1)
            s, e = (a - (t - w)) / S, (t - z) / S
            s = mean / 2 if s >= 1.1 * mean else s
            e = mean / 2 if e >= 1.1 * mean else e
            if inc > 0 and first >= 0:
                s = min(s, sampled * first / inc)
            out[pod, t] = inc * (sampled + s + e) / sampled / (w / S)
    return out


@pytest.mark.parametrize("chunks,step", [(1, 60), (3, 45), (50, 300)])
def test_rate_on_a_grid(spark, chunks, step):
    rows, w = _data(chunks), 300 * S
    grid = range(30 * S, 15000 * S, step * S)
    got = GR.rate_grid(_samples(spark, rows), grid[0], grid[-1], step * S, w, chunks)
    got = {(r["pod"], r["t"]): r["rate"] for r in got.select(MT.label("pod").alias("pod"), MT.epoch_micros(F.col("ts")).alias("t"), "rate").collect()}
    want = brute_rate(rows, grid, w)
    assert set(got) == set(want) and len(want) > 40
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


@pytest.mark.parametrize("chunks,step", [(1, 60), (4, 100)])
def test_current_values_on_a_grid(spark, chunks, step):
    rows, back = _data(7), 120 * S
    grid = range(-300 * S, 15000 * S, step * S)
    df = GR.instant_grid(_samples(spark, rows), grid[0], grid[-1], step * S, back, chunks)
    got = {(r["pod"], r["t"]): r["value"] for r in df.select(MT.label("pod").alias("pod"), MT.epoch_micros(F.col("ts")).alias("t"), "value").collect()}
    want = {(p, t): [v for x, v in all_ if t - back < x <= t][-1] for p, all_ in _series(rows).items() for t in grid
            if any(t - back < x <= t for x, _ in all_)}
    assert got == want
    sums = {r["t"]: r["value"] for r in GR.sum_by_step(df, []).select(MT.epoch_micros(F.col("ts")).alias("t"), "value").collect()}
    assert all(abs(sums[t] - sum(v for (_, x), v in want.items() if x == t)) < 1e-6 for t in sums)


def test_no_samples(spark):
    empty = _samples(spark, _data(1)).where("value < -1")
    assert GR.rate_grid(empty, 0, 100 * S, S, 10 * S).count() == 0 == GR.instant_grid(empty, 0, 100 * S, S, 10 * S).count()


def test_a_series_is_spread_over_chunks_by_two_shuffles(spark):
    plan = GR.rate_grid(_samples(spark, _data(1)), 0, 15000 * S, 60 * S, 300 * S, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_window_tasks_follow_the_rows(spark, monkeypatch):
    rows = _data(1)
    df = _samples(spark, rows)
    args = (0, 14_400 * S, 600 * S, 900 * S)
    want = {(r["labels"]["pod"], r["ts"], r["rate"]) for r in GR.rate_grid(df, *args).collect()}
    monkeypatch.setattr(SP, "TASK_ROWS", 100)
    out = GR.rate_grid(df, *args)
    assert out.rdd.getNumPartitions() == -(-3 * len(rows) // 100) > 30
    assert {(r["labels"]["pod"], r["ts"], r["rate"]) for r in out.collect()} == want
    total = SP.running_total(df.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["metric"], ["t"], F.lit(1).cast("long"), "k")
    assert total.rdd.getNumPartitions() == -(-len(rows) // 100) > 10
