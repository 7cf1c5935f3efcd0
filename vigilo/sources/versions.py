"""A table's versions as a log of numbered commits.

``root/_log/<number>.json`` names the folder that holds a version; the rows are
written first, to a folder of their own.  A commit is the exclusive creation of
the next number's record, which the store grants to one writer only (HDFS and
local folders; an object store needs conditional writes).  A writer states the
version it started from, so one that came too late is refused instead of hiding
another's version, and its rows are removed.  Versions are never changed; any of
them can be read again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vigilo.sources import lake as L

LOG = "_log"


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


def _record(root: str, version: int) -> str:
    return f"{root}/{LOG}/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """All committed versions, ascending (one listing of the log)."""
    if not L.exists(spark, f"{root}/{LOG}"):
        return []
    return sorted(int(n.removesuffix(".json")) for n, _ in L.dataset_names(spark, f"{root}/{LOG}") if n.endswith(".json") and n[:-5].isdigit())


def commit(df: DataFrame, root: str, parent: int | None = None, fmt: str = "parquet") -> int:
    """Write ``df`` as the version after ``parent`` (default: the newest one when
    the call begins; 0 before the first) and return its number."""
    spark = df.sparkSession
    if parent is None:
        parent = max(versions(spark, root), default=0)
    folder = f"data/{uuid.uuid4().hex}"
    manifest = L.write_complete(df, f"{root}/{folder}", fmt)
    record = {"version": parent + 1, "folder": folder, "format": fmt, "schema": df.schema.jsonValue(), **manifest}
    if parent and not L.exists(spark, _record(root, parent)) or not L.put_text(spark, _record(root, parent + 1), json.dumps(record)):
        fs, where = L._folder(spark, f"{root}/{folder}")
        fs.delete(where, True)
        raise VersionConflict(f"version {parent + 1} of {root} cannot follow {parent}: newest is {max(versions(spark, root), default=0)}")
    return parent + 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the newest), with the schema it was
    written with."""
    if version is None:
        version = max(versions(spark, root), default=0)
    text = L.get_text(spark, _record(root, version)) if version else None
    if text is None:
        raise FileNotFoundError(f"no version {version} under {root}")
    record = json.loads(text)
    return L.read_dataset(spark, f"{root}/{record['folder']}", StructType.fromJson(record["schema"]), record["format"])
