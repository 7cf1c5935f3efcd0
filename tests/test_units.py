"""Unit checks of helpers not covered by the oracle queries."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vigilo.operators import encode as E
from vigilo.operators import metrics as MT
from vigilo.operators import profile as P
from vigilo.operators import split as SP
from vigilo.sources import lake as L

from paths import SF_SMALL


def _samples(spark):
    rows = [({"pod": "shopfront-1", "container": "app"}, 1.0),
            ({"pod": "shopfront-2", "container": "POD"}, 2.0),
            ({"pod": "other-1"}, 3.0),
            ({"pod": "xshopfront"}, 4.0)]
    return spark.createDataFrame([("m", lab, v) for lab, v in rows],
                                 "metric string, labels map<string,string>, value double")


def test_label_matchers(spark):
    df = _samples(spark)
    got = lambda ms: sorted(r["value"] for r in MT.select_series(df, "m", ms).collect())
    assert got([("pod", "=~", "shopfront.*")]) == [1.0, 2.0]          # anchored
    assert got([("pod", "=~", "shopfront.*"), ("container", "!=", "POD")]) == [1.0]
    assert got([("container", "!=", "")]) == [1.0, 2.0]                # missing = empty
    assert got([("container", "=", "")]) == [3.0, 4.0]
    assert got([("pod", "!~", "shopfront.*")]) == [3.0, 4.0]


def test_series_name_thresholds_and_mapping(spark):
    df = _samples(spark).select(
        MT.series_name("{{pod}} - RX").alias("name"),
        MT.threshold_class(F.col("value") * 3, [(5.0, "yellow"), (8.0, "red")]).alias("c"),
        MT.map_values(F.col("value"), {"1.0": "one"}).alias("t"))
    rows = [(r["name"], r["c"], r["t"]) for r in df.collect()]
    assert rows[0] == ("shopfront-1 - RX", "green", "one")
    assert rows[1] == ("shopfront-2 - RX", "yellow", "2.0")
    assert rows[2][1] == "red" and rows[3][1] == "red"


def test_apply_codes_error_keep_skip(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    codes = E.code_table(fit, ["c"], "alphabetical")
    new = spark.createDataFrame([("b",), ("z",)], "c string")
    keep = {r["c"]: r["c_encoded"] for r in E.apply_codes(new, codes, "c", handle_invalid="keep").collect()}
    assert keep == {"b": 1, "z": 2}
    assert [r["c"] for r in E.apply_codes(new, codes, "c", handle_invalid="skip").collect()] == ["b"]
    with pytest.raises(Exception, match="unseen label in c: z"):
        E.apply_codes(new, codes, "c", handle_invalid="error").collect()
    assert [(r["column"], r["label"]) for r in E.unseen_labels(new, codes, ["c"]).collect()] == [("c", "z")]
    freq = {r["label"]: r["code"] for r in E.code_table(fit, ["c"], "frequency").collect()}
    assert freq == {"b": 0, "a": 1}


def test_min_rows_gate(spark):
    small, big = spark.range(3), spark.range(10)
    assert P.min_rows_gate(big, 5).count() == 10
    assert P.min_rows_gate(small, 5, fallback=big).count() == 10
    with pytest.raises(ValueError):
        P.min_rows_gate(small, 5)
    with pytest.raises(ValueError, match="empty"):
        P.min_rows_gate(spark.range(0), 5, fallback=big)


def test_hash_split_is_stable_across_partitionings(spark):
    df = spark.range(2000).withColumn("k", F.col("id") * 7)
    a = {r["id"]: r["split"] for r in SP.hash_split(df, ["id", "k"]).collect()}
    b = {r["id"]: r["split"] for r in SP.hash_split(df.repartition(7), ["id", "k"]).collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.75 < share < 0.85


def test_building_queries_runs_no_probing_jobs(spark):
    """Building a query starts no job but the one that reads a table's schema."""
    from vigilo.plans import food_queries, metric_queries, scoring_queries
    queries = {**food_queries.QUERIES, **metric_queries.QUERIES, **scoring_queries.QUERIES}
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for name, tables in (("food_features", 2), ("portion_nutrients", 2), ("random_split", 2),
                         ("metric_select", 1), ("sensor_anomalies", 1)):
        before = jobs()
        queries[name](spark, SF_SMALL)
        assert len(jobs() - before) <= tables, name


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from vigilo.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_ranked_over_many_partitions(spark):
    rows = [("a", f"w{i % 700}", i) for i in range(1400)] + [("b", "x", 1), (None, "n", 0), (None, "m", 5)]
    df = spark.createDataFrame(rows, "g string, w string, i long").repartition(5)
    got = {(r["g"], r["w"], r["i"]): r["rank"] for r in SP.ranked(df, ["g"], [F.desc("w"), F.asc("i")]).collect()}
    for g in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: ([-ord(c) for c in r[1]] + [1], r[2]))
        want = sorted(sorted((r for r in rows if r[0] == g), key=lambda r: r[2]), key=lambda r: r[1], reverse=True)
        assert [got[r] for r in want] == list(range(1, len(want) + 1))


def test_profile_and_missing(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, "x"), (None, "y")], "a double, b string")
    prof = P.profile(df, ["a"]).first()
    assert (prof["count"], prof["mean"], prof["min"], prof["max"]) == (2, 2.0, 1.0, 3.0)
    assert abs(prof["stddev"] - 1.414214) < 1e-6
    miss = P.missing_counts(df).first()
    assert (miss["a"], miss["b"]) == (1, 1)


def test_ingest_metadata_counts_rows(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4, "food_item string, calories double")
    row = L.ingest_metadata(df, "csv", "unit").first()
    assert row["total_records"] == 4
    assert row["schema"] == '{"food_item":"string","calories":"double"}'


def test_memory_sizing_helpers(spark):
    from vigilo.plans import ml
    assert [ml._memory_mb(t) for t in ("1g", "12g", "512m", "2048", "4096mb")] == \
        [1024, 12288, 512, 2048, 4096]
    per_task = ml.tree_pass_memory(spark)
    heap = ml._memory_mb(spark.sparkContext.getConf().get("spark.driver.memory", "1g"))
    assert 32 <= per_task <= 1024
    assert per_task * spark.sparkContext.defaultParallelism <= heap // 4 or per_task == 32


def test_cluster_profile_sizes_shuffles():
    from vigilo.session import cluster_profile
    conf = cluster_profile(100 * 2 ** 40, executors=1000, cores_per_executor=8)
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts == 409600                          # 100 TB / 256 MB
    assert conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(parts)
    small = cluster_profile(10 * 2 ** 30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80   # at least two waves of 40 slots
