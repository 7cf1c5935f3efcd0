"""One read of a topic, several sinks, every record once in each.

``fan_out`` runs one streaming query whose micro-batches are read and parsed
once; each output is derived from the parsed rows and written to a plain sink
(a folder of any batch format, no streaming log).

A micro-batch may be replayed: the driver can stop after a sink was written and
before the query commits the batch.  Each sink therefore has a ledger with one
record for each (query, batch id), put there after the batch's rows are
complete.  A batch that a sink's ledger holds is left out; one whose rows were
written without a record (or in part) is written again over its own folder.
``read_sink`` returns the rows of recorded batches only, so a reader never sees
half a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vigilo.operators import messages as M
from vigilo.operators import scoring as S
from vigilo.sources import lake as L

LEDGER = "_ledger"  # readers of the sink pass over names with an underscore
MARK = "query string, batch long"


def _mark(sink: str, query: str, batch: int) -> str:
    return f"{sink}/{LEDGER}/{query}-{batch}.json"


def write_once(rows: DataFrame, batch: int, sink: str, query: str, fmt: str = "parquet") -> bool:
    """Write a micro-batch unless the sink's ledger has it; whether it did.
    ``query`` is a name that stays the same when the query is started again."""
    spark = rows.sparkSession
    if L.exists(spark, _mark(sink, query, batch)):
        return False
    rows.write.mode("overwrite").format(fmt).save(f"{sink}/query={query}/batch={batch}")
    L.put_text(spark, _mark(sink, query, batch), json.dumps({"query": query, "batch": batch}))
    return True


def read_sink(spark: SparkSession, sink: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of all recorded batches.  The ledger is one small row a batch,
    joined by the batch folders' names, so unrecorded folders are not read."""
    if not L.exists(spark, f"{sink}/{LEDGER}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.format(fmt).schema(StructType([*schema.fields, *_fields()])).load(sink)
    marks = spark.read.schema(MARK).json(f"{sink}/{LEDGER}")
    return rows.join(marks, ["query", "batch"], "left_semi").select(*schema.names)


def _fields():
    return StructType.fromDDL(MARK).fields


def fan_out(stream: DataFrame, parse: Callable[[DataFrame], DataFrame],
            outputs: dict[str, Callable[[DataFrame], DataFrame]], root: str, query: str,
            available_now: bool = True) -> StreamingQuery:
    """Start the query ``query``: ``parse`` once a micro-batch, then each of
    ``outputs`` from the parsed rows into ``root/<output name>``.  The parsed
    rows are persisted for as long as the batch takes, on memory and disk; a
    lost executor's part is read and parsed again."""
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        open_ = [n for n in outputs if not L.exists(spark, _mark(f"{root}/{n}", query, number))]
        if not open_:
            return
        parsed = parse(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in open_:
                write_once(outputs[name](parsed), number, f"{root}/{name}", query)
        finally:
            parsed.unpersist()

    writer = (stream.writeStream.queryName(query).foreachBatch(each)
              .option("checkpointLocation", f"{root}/_checkpoint-{query}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: The sinks of the sensor topic, each from the same parsed rows.
SENSOR_OUTPUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "anomalies": lambda parsed: S.sensor_anomalies(M.accepted(parsed)),
    "dead_letters": M.dead_letters,
    "audit_lines": lambda parsed: S.sensor_audit_lines(M.accepted(parsed)),
}


def sensor_fan_out(stream: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    return fan_out(stream, M.parse_sensor, SENSOR_OUTPUTS, root, "sensor", available_now)
