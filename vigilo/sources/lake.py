"""Lake reads and writes: CSV / Parquet / JSON / text under a lake root.

A "lake" is any Hadoop-compatible path (HDFS, object store, local).
Every operation is a Spark reader or writer, so files are produced and
consumed in parallel by the executors; nothing passes through the driver.
Credentials come from the Spark/Hadoop configuration, never from code.
"""

from __future__ import annotations

import datetime as _dt
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilo.functions.rules import iso_instant

# Fixed folder names of the lake layout.
RAW, PROCESSED, MODELS = "raw-data", "processed-data", "ml-models"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer: bool = False) -> DataFrame:
    """CSV with a header.  Pass ``schema`` in production: inferring types
    costs an extra full pass over the files."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_or_none(spark: SparkSession, path: str,
                     schema: StructType | str | None = None) -> DataFrame | None:
    """``None`` when the path does not exist, so a caller can fall back; any
    other failure (permission, schema) surfaces."""
    return read_csv(spark, path, schema) if exists(spark, path) else None


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a lake path, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small record as one file; whether it did.  Without ``overwrite``
    a file that is there already is left as it is: of several writers of one
    path only the first succeeds (the store's exclusive create)."""
    fs, where = _folder(spark, path)
    try:
        out = fs.create(where, overwrite)
    except Py4JJavaError as exc:
        if not overwrite and fs.exists(where):
            return False
        raise exc
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small record, ``None`` when there is none."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def read_or_fallback(spark: SparkSession, path: str, schema: StructType | str, min_rows: int,
                     fallback: DataFrame) -> DataFrame:
    """The data set at ``path`` when it is there and long enough; otherwise
    ``fallback``, which is written to ``path`` and read back from it."""
    found = read_csv_or_none(spark, path, schema)
    if found is not None and len(found.select(F.lit(1)).take(min_rows)) >= min_rows:
        return found
    write_csv(fallback, path)
    return read_csv(spark, path, schema=fallback.schema)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_if_absent(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Idempotent ingest: write only when nothing exists at ``path``."""
    writer = df.write.mode("ignore")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def versioned_write(spark: SparkSession, df: DataFrame, root: str, version: str,
                    fmt: str = "parquet") -> str:
    """Write ``root/v=<version>/`` once, then point ``root/latest/`` at it.

    The pointer is a record of its own, added only when the version is
    complete; nothing is copied and readers never find a gap."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").format(fmt).save(path)
    spark.createDataFrame([(version, path)], "version string, path string").coalesce(1) \
        .write.mode("append").json(f"{root}/latest")
    return path


def read_latest(spark: SparkSession, root: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The version that ``root/latest/`` points at: the last by version text."""
    newest = spark.read.schema("version string, path string").json(f"{root}/latest") \
        .orderBy(F.desc("version")).first()
    if newest is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.format(fmt).schema(schema).load(newest["path"])


def verify_write(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write, read back and compare row counts: one row ``(rows_written,
    rows_read, verified)``.  The first count is observed on the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt).save(path)
    written = seen.get["rows"]
    read = spark.read.format(fmt).schema(df.schema).load(path).count()
    return spark.range(1).select(F.lit(written).cast("long").alias("rows_written"),
                                 F.lit(read).cast("long").alias("rows_read"),
                                 F.lit(written == read).alias("verified"))


# As text, times keep their microseconds (Spark's own CSV format has three digits).
_CSV = {"header": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
MANIFEST = "_manifest.json"  # readers pass over names with an underscore


def table_digest(columns: list[str]) -> list[Column]:
    """``(rows, digest)`` aggregates of a table: the digest is the sum of the rows'
    64-bit hashes, so it depends on every value and on no order or layout."""
    total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(total.cast("string"), F.lit("0")).alias("digest")]


def write_complete(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Write a data set and then its manifest (rows and digest, observed on the
    write itself).  The manifest is the last thing written and goes first when
    a data set is replaced, so a folder without one is not whole."""
    seen = Observation()
    writer = df.observe(seen, *table_digest(df.columns)).write.mode("overwrite").format(fmt)
    writer.options(**_CSV if fmt == "csv" else {}).save(path)
    manifest = {"rows": seen.get["rows"], "digest": seen.get["digest"]}
    put_text(df.sparkSession, f"{path}/{MANIFEST}", json.dumps(manifest), overwrite=True)
    return manifest


def read_dataset(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """What ``write_complete`` wrote."""
    return spark.read.schema(schema).format(fmt).options(**_CSV if fmt == "csv" else {}).load(path)


def is_complete(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", content: bool = True) -> bool:
    """Whether the data set at ``path`` was written to its end and, with
    ``content`` (one scan), still holds the rows that were written."""
    text = get_text(spark, f"{path}/{MANIFEST}")
    if text is None or not content:
        return text is not None
    rows = read_dataset(spark, path, schema, fmt)
    return rows.agg(*table_digest(rows.columns)).first().asDict() == json.loads(text)


def ingest_once(df: DataFrame, path: str, fmt: str = "parquet", content: bool = True) -> bool:
    """Write ``df`` unless a whole, unchanged data set is there; whether it did.
    What a stopped run left behind is replaced."""
    if is_complete(df.sparkSession, path, df.schema, fmt, content):
        return False
    write_complete(df, path, fmt)
    return True


def dataset_names(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """``(dataset, path)`` of every data set in ``root``: a file, or the folder
    a Spark writer produced.  One level is listed, no part files."""
    fs, where = _folder(spark, root)
    return [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(where)]


def latest_dataset(spark: SparkSession, root: str, schema: StructType | str,
                   contains: str, suffix: str = ".csv") -> DataFrame:
    """Rows of the lexicographically last data set under ``root`` whose
    name contains ``contains`` and ends with ``suffix``.

    The name is picked from the folder's own listing; then only that data
    set is scanned.
    """
    wanted = [n for n in dataset_names(spark, root) if contains in n[0] and n[0].endswith(suffix)]
    if not wanted:
        raise FileNotFoundError(f"no data set matching {contains!r}*{suffix} under {root}")
    return read_csv(spark, max(wanted)[1], schema=schema)


def run_id(now: _dt.datetime | None = None) -> str:
    """Version text ``%Y%m%d-%H%M%S``."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d-%H%M%S")


def schema_map(df: DataFrame) -> Column:
    """``map(column -> simple type name)`` of a frame, as a literal."""
    entries = []
    for name, dtype in df.dtypes:
        entries += [F.lit(name), F.lit(dtype)]
    return F.create_map(*entries)


def ingest_metadata(df: DataFrame, fmt: str, source: str, now: Column | None = None) -> DataFrame:
    """One-row metadata record with the real row count (one aggregation)."""
    now = now if now is not None else F.current_timestamp()
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        iso_instant(now).alias("ingestion_timestamp"),
        "total_records", F.lit(fmt).alias("data_format"), F.lit(source).alias("source"),
        F.to_json(schema_map(df)).alias("schema"))


def write_json_record(df: DataFrame, path: str) -> None:
    """A small record (one or a few rows) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
