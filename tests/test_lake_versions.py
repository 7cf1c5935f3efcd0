"""Manifests, commit log of versions, mergeable distinct counts."""

import pytest
from pyspark.sql import functions as F

from vigilo.operators import sketches as SK
from vigilo.session import scratch_path
from vigilo.sources import lake as L
from vigilo.sources import versions as VL
from vigilo.sources.tables import read_table


def _rows(spark, n=100):
    return spark.range(n).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t, "), "id")).alias("t"),
                                 F.timestamp_micros(F.col("id") * 1_000_001).cast("timestamp_ntz").alias("at"))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_half_written_data_is_ingested_again(spark, fmt):
    path = scratch_path(spark, "once") + "/data"
    whole = _rows(spark)
    part = whole.where("id < 40").write.mode("overwrite")
    (part.option("header", True) if fmt == "csv" else part).format(fmt).save(path)
    assert not L.is_complete(spark, path, whole.schema, fmt)
    assert L.ingest_once(whole, path, fmt) and L.is_complete(spark, path, whole.schema, fmt)
    assert not L.ingest_once(whole.where("id > 90"), path, fmt)
    got = L.read_dataset(spark, path, whole.schema, fmt)
    assert got.exceptAll(whole).isEmpty() and got.count() == 100


def test_a_changed_row_and_a_lost_file_are_found(spark):
    path = scratch_path(spark, "digest") + "/data"
    whole = _rows(spark).repartition(4)
    manifest = L.write_complete(whole, path)
    assert manifest["rows"] == 100
    for other in (whole.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x"))), whole.where("id <> 3"), whole.union(whole.where("id = 3"))):
        assert L.write_complete(other, scratch_path(spark, "digest") + "/data") != manifest
    assert L.write_complete(whole.orderBy(F.desc("id")).coalesce(1), scratch_path(spark, "digest") + "/data") == manifest
    fs, where = L._folder(spark, path)
    fs.delete(next(s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), False)
    assert not L.is_complete(spark, path, whole.schema) and L.is_complete(spark, path, whole.schema, content=False)


def test_digest_of_no_rows(spark):
    path = scratch_path(spark, "digest-none") + "/data"
    none = _rows(spark).where("id < 0")
    assert L.write_complete(none, path) == {"rows": 0, "digest": "0"}
    assert L.is_complete(spark, path, none.schema) and not L.ingest_once(_rows(spark), path)


def test_two_writers_one_wins(spark, monkeypatch):
    root = scratch_path(spark, "log") + "/t"
    assert VL.versions(spark, root) == [] and VL.commit(_rows(spark, 5), root) == 1
    write, done = L.write_complete, []

    def overtaken(df, path, fmt="parquet"):
        """While the first writer writes its rows, another one commits."""
        out = write(df, path, fmt)
        if not done:
            done.append(VL.commit)
            assert VL.commit(_rows(spark, 7), root) == 2
        return out

    monkeypatch.setattr(L, "write_complete", overtaken)
    with pytest.raises(VL.VersionConflict):
        VL.commit(_rows(spark, 9), root)
    monkeypatch.undo()
    assert VL.versions(spark, root) == [1, 2]
    assert [VL.read(spark, root, v).count() for v in (1, 2, None)] == [5, 7, 7]
    assert VL.commit(_rows(spark, 9), root, fmt="csv") == 3 and VL.read(spark, root).exceptAll(_rows(spark, 9)).isEmpty()
    assert len(L.dataset_names(spark, f"{root}/data")) == 3  # the refused rows are gone
    with pytest.raises(VL.VersionConflict):
        VL.commit(_rows(spark, 1), root, parent=7)
    with pytest.raises(FileNotFoundError):
        VL.read(spark, root, 9)


def test_only_one_record_can_be_put(spark):
    path = scratch_path(spark, "put") + "/a.json"
    assert [L.put_text(spark, path, t) for t in ("one", "two")] == [True, False] and L.get_text(spark, path) == "one"
    assert L.put_text(spark, path, "drei ü", overwrite=True) and L.get_text(spark, path) == "drei ü"
    assert L.get_text(spark, path + "x") is None


def test_sketches_merge(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("day"), (F.col("id") % 900).alias("v"))
    days = SK.sketches(df, ["day"], "v")
    few = SK.merged(days.where("day < 2"), []).first()["estimate"]
    assert few == df.where("day < 2").select("v").distinct().count()  # small counts are exact
    assert SK.merged(days, []).first()["estimate"] == SK.merged(SK.sketches(df, [], "v"), []).first()["estimate"]
    assert SK.merged(days.where("day < 0"), ["day"]).count() == 0


def test_day_sketches_over_a_whole_table(spark):
    items = read_table(spark, "/root/testdata/sf0.1", "lineitem", ["l_shipdate", "l_orderkey"]).withColumn("day", F.to_date("l_shipdate"))
    days = SK.sketches(items, ["day"], "l_orderkey")
    exact = items.select("l_orderkey").distinct().count()
    by_days = SK.merged(days, []).first()["estimate"]
    by_years = SK.merged(SK.merged(days.withColumn("year", F.year("day")), ["year"]), []).first()["estimate"]
    at_once = SK.merged(SK.sketches(items, [], "l_orderkey"), []).first()["estimate"]
    assert by_days == by_years and max(abs(by_days - exact), abs(at_once - exact)) <= SK.BOUND * exact
