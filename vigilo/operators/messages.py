"""Message parsing with a dead-letter split.

``parse_sensor``/``parse_user`` keep every input row and add ``parse_ok``
plus the typed fields (NULL when not ok).  ``accepted``/``dead_letters``
split on that flag, so one parse serves both outputs.  All of it is a
narrow projection: it runs per partition with no shuffle, in batch and in
streaming alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.functions import coercion as C

# Fields each rule reads, in the order it reads them.
SENSOR_FIELDS = ["temperature", "humidity", "sensor_id", "timestamp"]
USER_FIELDS = ["user_id", "action", "page_id"]


def _error(doc: Column, fields: list[str], int_values: dict[str, Column]) -> Column:
    """Why a record cannot be used, or NULL when it can.

    The common case (an object holding every field) is decided first by
    field lookups alone; the document's shape is inspected only for
    records that fail."""
    usable = C.all_present(doc, fields)
    for value in int_values.values():
        usable = usable & value.isNotNull()
    expr = F.when(doc.isNull(), F.lit("unparseable")).when(usable, F.lit(None).cast("string"))
    expr = expr.when(~F.schema_of_variant(doc).startswith("OBJECT"), F.lit("not_an_object"))
    for name in fields:
        expr = expr.when(~C.has_field(doc, name), F.lit(f"missing_field:{name}"))
    for name, value in int_values.items():
        expr = expr.when(value.isNull(), F.lit(f"bad_integer:{name}"))
    return expr


def _parse(messages: DataFrame, value_col: str, fields: dict[str, Column],
           error: Column) -> DataFrame:
    """Parse once, then emit ``parse_error``/``parse_ok`` and the fields.

    The JSON text is parsed a single time (``__doc``) and every field is
    computed in ordinary projections, where generated code shares common
    subexpressions.  The results then pass through a one-element
    ``inline`` generator that only repackages those columns: a filter on
    them (the dead-letter split, the rule filter) cannot be pushed below a
    generator, so the optimizer never copies the parse into the filter.
    """
    ok = F.col("parse_error").isNull()
    keep = [c for c in messages.columns if c not in fields]
    computed = (messages.withColumn("__doc", C.json_doc(F.col(value_col)))
                .withColumn("parse_error", error)
                .withColumns({name: F.when(ok, expr) for name, expr in fields.items()}))
    out = F.struct(F.col("parse_error"), ok.alias("parse_ok"), *[F.col(n) for n in fields])
    return computed.select(*keep, F.inline(F.array(out)))


def parse_sensor(messages: DataFrame, value_col: str = "value") -> DataFrame:
    doc = F.col("__doc")
    fields = {
        "sensor_id": C.lenient_text(doc, "sensor_id"),
        "original_timestamp": C.lenient_text(doc, "timestamp"),
        "temperature": C.lenient_double(doc, "temperature"),
        "humidity": C.lenient_double(doc, "humidity"),
    }
    return _parse(messages, value_col, fields, _error(doc, SENSOR_FIELDS, {}))


def parse_user(messages: DataFrame, value_col: str = "value") -> DataFrame:
    doc = F.col("__doc")
    fields = {
        "user_id": C.lenient_int(doc, "user_id"),
        "action": C.lenient_text(doc, "action"),
        "page_id": C.lenient_int(doc, "page_id"),
    }
    ints = {k: fields[k] for k in ("user_id", "page_id")}
    return _parse(messages, value_col, fields, _error(doc, USER_FIELDS, ints))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("parse_ok").drop("parse_ok", "parse_error")


def dead_letters(parsed: DataFrame, keep: tuple[str, ...] = ("topic", "key", "value", "event_id")) -> DataFrame:
    """Rejected records with the reason, instead of a line on stderr."""
    cols = [c for c in keep if c in parsed.columns]
    return parsed.where(~F.col("parse_ok")).select(*cols, F.col("parse_error").alias("error"))
