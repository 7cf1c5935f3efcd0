"""Readers for the provided parquet tables.

Every reader names the columns it needs, so the parquet scan only reads
those (``ReadSchema`` in ``explain``) and filters placed on top are pushed
into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collections.abc import Callable

from vigilo.session import scratch_path, table_path


def spread(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Spread an input of less than one scan split over the cluster, like the
    Kafka source's ``minPartitions``.

    A file that is one parquet row group is one split, so a small input
    would run in a single task.  Only such an input is repartitioned, in
    front of CPU-heavy per-row work; anything larger has more splits already
    and is returned as it is.  The size is the optimizer's estimate from the
    file listing, so nothing runs.  ``key`` should be (nearly) unique.
    """
    spark = df.sparkSession
    split = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > split:
        return df
    want = partitions or spark.sparkContext.defaultParallelism
    # Hash on a (near-)unique key is as even as round-robin and, unlike
    # round-robin, needs no local sort to stay deterministic on a retry.
    return df.repartition(want, key) if key else df.repartition(want)


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def table_state(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple:
    """What the tables are at this moment: path, modification time, number of
    files and bytes of each (two calls a table, no listing on the driver)."""
    out = []
    for table in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, table))
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        held = fs.getContentSummary(where)
        out += [fs.makeQualified(where).toString(), fs.getFileStatus(where).getModificationTime(), held.getFileCount(), held.getLength()]
    return tuple(out)


_WRITTEN: dict[tuple, str] = {}


def written_once(spark: SparkSession, sf_dir: str, tables: list[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A binding that costs shuffles, written to the scratch folder the first
    time an application asks for it and read from there; a table that was
    written again has another state and is bound anew."""
    key = (spark.sparkContext.applicationId, table_state(spark, sf_dir, tables), name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
