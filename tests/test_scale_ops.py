"""Skew-safe operators against brute force on small fixtures with one hot
group (a third or more of all rows)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from vigilo.operators import metrics as MT
from vigilo.operators import split as SP
from vigilo.sources import topics as T


def test_stratified_rank_matches_row_number(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, k long, i long")
    got = {r["i"]: r["rank"] for r in SP.stratified_rank(df, ["s"], ["k", "i"]).collect()}
    pdf = pd.DataFrame(rows, columns=["s", "k", "i"]).sort_values(["s", "k", "i"])
    pdf["rank"] = pdf.groupby("s").cumcount() + 1
    assert got == dict(zip(pdf["i"], pdf["rank"]))


def test_stratified_split_quota(spark):
    rows = [("hot" if i % 4 else "cold", i, i) for i in range(1001)]
    df = spark.createDataFrame(rows, "s string, k long, i long")
    out = SP.stratified_split(df, ["s"], ["k", "i"]).groupBy("s", "split").count()
    counts = {(r["s"], r["split"]): r["count"] for r in out.collect()}
    for s in ("hot", "cold"):
        n = counts[(s, "train")] + counts[(s, "test")]
        assert counts[(s, "train")] == (n * 80 + 99) // 100


def test_stratified_split_is_random_and_keeps_every_row(spark):
    rows = [(None if i % 5 == 0 else "s" if i % 3 else "t", None if i % 50 == 7 else 10 ** 15 if i == 9 else i, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "s string, k long, i long").repartition(6)
    out = SP.stratified_split(df, ["s"], ["k"], ["k", "i"]).collect()
    assert sorted(r["i"] for r in out) == list(range(4000))
    for s in (None, "s", "t"):
        part = [r for r in out if r["s"] == s]
        train = [r["i"] for r in part if r["split"] == "train"]
        assert len(train) == (len(part) * 80 + 99) // 100
        # Both sides cover the whole key range.
        for side in ("train", "test"):
            ids = [r["i"] for r in part if r["split"] == side]
            assert min(ids) < 400 and max(ids) > 3600
    again = SP.stratified_split(df.repartition(3), ["s"], ["k"], ["k", "i"]).collect()
    assert {(r["i"], r["split"]) for r in out} == {(r["i"], r["split"]) for r in again}


def test_stratified_split_whatever_the_buckets_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, 2, 2, 2, rng.randint(0, 900)]), rng.choice([None, 1, 2]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "s string, k long, t int, i long").repartition(5)
    sides = []
    for bits in (4, 8, 20):
        out = SP.stratified_split(df, ["s"], ["k"], ["t", "i"], train_pct=70, bits=bits)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        sides.append({r["i"]: r["split"] for r in out.collect()})
    assert sides[0] == sides[1] == sides[2] and len(sides[0]) == 1500
    # Rows that are equal in all order columns are parted by their number.
    again = SP.stratified_split(df, ["s"], ["k"], ["t"], train_pct=70).collect()
    assert sorted(r["i"] for r in again) == list(range(1500))
    for s in ("hot", "a", None):
        n = [r["split"] for r in again if r["s"] == s]
        assert n.count("train") == (len(n) * 70 + 99) // 100 == sum(sides[0][r[3]] == "train" for r in rows if r[0] == s)
    assert {r["split"] for r in SP.stratified_split(df, ["s"], ["k"], ["i"], train_pct=0).collect()} == {"test"}
    assert {r["split"] for r in SP.stratified_split(df, ["s"], ["k"], ["i"], train_pct=100).collect()} == {"train"}
    assert SP.stratified_split(df.where("i < 0"), ["s"], ["k"]).count() == 0


def test_running_total_with_null_groups_null_and_outlier_keys(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "a", None]), None if i % 40 == 3 else rng.choice([10 ** 12, -5, 7]) if i % 90 == 1 else rng.randint(0, 300), i, 1.0)
            for i in range(2500)]
    df = spark.createDataFrame(rows, "g string, t long, i long, v double")
    got = {r["i"]: r["total"] for r in SP.running_total(df, ["g"], ["t", "i"], F.col("v"), "total").collect()}
    assert len(got) == 2500
    for g in ("hot", "a", None):
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in part] == [float(n) for n in range(1, len(part) + 1)]


def test_peek_with_late_first_offsets_and_gaps(spark):
    rows = [("t", 0, o) for o in range(100, 120)] + [("t", 1, o) for o in (5, 90, 7000)] + [("u", 3, 42), (None, 0, 9), ("t", None, 1)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long")
    got = sorted(((r["topic"] or "", r["offset"]) for r in T.peek(df, 3).collect()))
    assert got == [("", 9), ("t", 1), ("t", 100), ("t", 101), ("u", 42)]


def _brute_rate(samples, w):
    out = []
    for key, grp in samples.groupby("pod"):
        grp = grp.sort_values("ts").reset_index(drop=True)
        steps = [None]
        for j in range(1, len(grp)):
            v, p = grp.value[j], grp.value[j - 1]
            steps.append(v if v < p else v - p)
        for j in range(len(grp)):
            t = grp.ts[j]
            idx = [i for i in range(len(grp)) if t - w < grp.ts[i] <= t]
            if len(idx) < 2:
                continue
            inc = sum(steps[i] for i in idx[1:])
            secs = (t - grp.ts[idx[0]]).total_seconds()
            out.append((key, t, round(inc / secs, 9)))
    return sorted(out)


import pytest


@pytest.mark.parametrize("chunk_windows", [1, 2, 5])
def test_chunked_rate_matches_brute_force(spark, chunk_windows):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows, value = [], {}
    for i in range(900):
        pod = "pod-hot" if i % 2 else f"pod-{rng.randint(0, 5)}"
        ts = base + dt.timedelta(seconds=rng.randint(0, 6 * 3600))
        rows.append((pod, ts))
    for i in range(40):   # a sparse series: gaps often longer than the window
        rows.append(("pod-sparse", base + dt.timedelta(seconds=rng.randint(0, 6 * 3600))))
    rows = sorted(set(rows), key=lambda r: (r[0], r[1]))
    data = []
    for pod, ts in rows:
        v = value.get(pod, 0.0)
        v = 0.0 if rng.random() < 0.05 else v + rng.randint(1, 9)   # counter with resets
        value[pod] = v
        data.append((pod, ts, v))
    df = spark.createDataFrame(data, "pod string, ts timestamp_ntz, value double").select(
        F.lit("m").alias("metric"), F.create_map(F.lit("pod"), F.col("pod")).alias("labels"),
        "ts", "value")
    w = 600
    got = MT.rate(df, w, chunk_windows=chunk_windows).select(MT.label("pod").alias("pod"), "ts", "rate")
    got = sorted((r["pod"], r["ts"], round(r["rate"], 9)) for r in got.collect())
    want = _brute_rate(pd.DataFrame(data, columns=["pod", "ts", "value"]), dt.timedelta(seconds=w))
    assert got == want


def test_topic_peek_and_totals(spark):
    rows = [("t1" if i % 3 else "t2", i % 4, i, f"v{i}") for i in range(400)]
    recs = spark.createDataFrame(rows, "topic string, partition int, event_id long, value string")
    ranked = SP.stratified_rank(recs, ["topic", "partition"], ["event_id"])
    recs = ranked.withColumn("offset", F.col("rank") - 1).drop("rank")
    peek = T.peek(recs, 3).orderBy("topic", "partition", "offset").collect()
    assert [(r["topic"], r["partition"], r["offset"]) for r in peek] == \
        [("t1", 0, 0), ("t1", 0, 1), ("t1", 0, 2), ("t2", 0, 0), ("t2", 0, 1), ("t2", 0, 2)]
    totals = {r["topic"]: r["messages"] for r in T.totals(recs).collect()}
    assert totals == {"t1": sum(1 for r in rows if r[0] == "t1"), "t2": sum(1 for r in rows if r[0] == "t2")}


def test_running_total_matches_cumsum(spark):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else rng.choice("xy"), rng.randint(0, 10_000), i, rng.random() * 10)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t long, i long, v double")
    got = {r["i"]: r["total"] for r in
           SP.running_total(df, ["g"], ["t", "i"], F.col("v"), "total").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "t", "i", "v"]).sort_values(["g", "t", "i"])
    pdf["total"] = pdf.groupby("g")["v"].cumsum()
    for i, want in zip(pdf["i"], pdf["total"]):
        assert abs(got[i] - want) < 1e-6 * max(1.0, want)
