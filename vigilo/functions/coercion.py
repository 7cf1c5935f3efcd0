"""Lenient JSON field reads as Spark column expressions.

Messages arrive as JSON text.  A record is usable only when the text is a
JSON object holding every field the rule needs; otherwise it is a dead
letter.  Present fields are read leniently:

* numbers: numeric text (``"36.5"``) and booleans convert; JSON null,
  non-numeric text, objects and arrays read as ``0.0``;
* integers: read as a double, then truncated toward zero (``46.9`` -> 46);
  a value outside the 32-bit range has no integer and is a dead letter;
* text: a string is itself, a number is its digits, JSON null is the text
  ``null``, an object or array is empty text.

All reads go through VARIANT (``try_parse_json``/``try_variant_get``), so
they stay inside whole-stage code generation; no Python runs per row.
``from_json`` is deliberately not used: it accepts single quotes and bare
``NaN`` and does not convert numeric text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_doc(text: Column) -> Column:
    """Parse JSON text to VARIANT; malformed or empty text gives NULL."""
    return F.try_parse_json(text)


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def field(doc: Column, name: str) -> Column:
    """The raw VARIANT of a field; SQL NULL when the field (or an object
    root) is absent, a VARIANT null when the field holds JSON null."""
    return F.try_variant_get(doc, _path(name), "variant")


def has_field(doc: Column, name: str) -> Column:
    return field(doc, name).isNotNull()


def lenient_double(doc: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, _path(name), "double"), F.lit(0.0))


def lenient_int(doc: Column, name: str) -> Column:
    value = lenient_double(doc, name)
    # NaN truncates to 0 like a Java (int) cast; +-Infinity and anything
    # beyond 32 bits has no int and becomes NULL (a dead letter).
    return F.when(F.isnan(value), F.lit(0)).otherwise(value.try_cast("int"))


def lenient_text(doc: Column, name: str) -> Column:
    raw = field(doc, name)
    kind = F.schema_of_variant(raw)
    return (F.when(F.is_variant_null(raw), F.lit("null"))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(""))
            .otherwise(F.try_variant_get(doc, _path(name), "string")))


def all_present(doc: Column, names: list[str]) -> Column:
    cond = doc.isNotNull()
    for name in names:
        cond = cond & has_field(doc, name)
    return cond
