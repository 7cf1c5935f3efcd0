"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.session import scratch_path
from vigilo.sources.tables import read_table

KEY, TEXT = "doc_id", "text"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, reading only the named columns."""
    return read_table(spark, sf_dir, "documents", list(columns or (KEY, TEXT)))


WHOLE = ("bigint", "int", "smallint", "tinyint")


def pick(df: DataFrame, key: str, text: str, any_key: bool = False) -> DataFrame:
    """Key and text under fixed names; every other column is left behind.  Keys
    are integers and become longs, unless the caller takes ``any_key``."""
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    own = F.col(f"`{key}`")
    if kind in WHOLE:
        own = own.cast("long")
    elif not any_key:
        raise TypeError(f"key column {key!r} has to be an integer, not {kind}")
    return df.select(own.alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``; batches are bounded in bytes by ``session.RUNTIME_CONF``."""
    return df.mapInArrow(fn, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: lineage ends here, and a
    lost executor costs the tasks that read it, not the work before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLICE_ROWS = 512


def by_batch_of(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, lists: bool = True) -> DataFrame:
    """Row-wise Python in Arrow batches, without a shuffle: ``fn`` gets a list
    (or, without ``lists``, an Arrow array) for each column of ``df`` and
    returns the output columns by name.  Batches are cut into slices of
    ``SLICE_ROWS`` rows, which bounds what a worker holds as Python objects."""
    out = pa.schema([(n, _arrow(t)) for n, t in (c.strip().split(" ", 1) for c in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(s, SLICE_ROWS)
                cols = fn(*[c.to_pylist() if lists else c for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in ((cols[f.name], f) for f in out)], schema=out)

    return in_arrow(df, run, schema)


def with_columns(df: DataFrame, text: str, fn: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """``df`` with more columns, computed by ``fn`` from the list of a slice's
    texts; columns of the same names are replaced, the others pass through."""
    new = [(n, t.strip()) for n, t in (c.strip().split(" ", 1) for c in schema.split(","))]
    names = [n for n, _ in new]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c == text])
    at = kept.columns.index(text)
    fields = [f for f in kept.schema if f.name not in names]
    shape = T.StructType([*fields, *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(s, SLICE_ROWS)
                cols = fn(part.column(at).to_pylist())
                more = [cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n], _arrow(t)) for n, t in new]
                passed = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in names]
                yield pa.RecordBatch.from_arrays([*(c for _, c in passed), *more], names=[*(n for n, _ in passed), *names])

    return in_arrow(kept, run, shape)


def _arrow(kind: str) -> pa.DataType:
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
            "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}[kind]
