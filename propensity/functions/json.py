"""JSON property access on the events' ``properties`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(col: Column | str, path: str) -> Column:
    """Text at a JSON path; NULL when the document, the key or the value is missing
    and also when the text is empty (an empty id counts as absent).  Malformed JSON
    yields NULL rather than an error."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.get_json_object(c, path), F.lit(""))


def session_id(properties: Column | str = "properties") -> Column:
    """``properties.session_id`` as a nullable string."""
    return json_text(properties, "$.session_id")


def json_nested(col: Column | str, path: str, type_: str = "string") -> Column:
    """Typed value at an arbitrary nested path through the VARIANT type
    (``$.a.b[0]``); a missing path or incompatible value yields NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_variant_get(F.try_parse_json(c), path, type_)


def variant(col: Column | str) -> Column:
    """The document as a VARIANT, parsed once for any number of paths; NULL where it is no JSON."""
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def at(document: Column | str, path: str, type_: str = "string") -> Column:
    """Typed value of a VARIANT at a path (``$.a.b[0]``): NULL where the path is missing, holds
    JSON null, or holds a value that can't become that type."""
    return F.try_variant_get(F.col(document) if isinstance(document, str) else document, path, type_)


def explode_array(df: DataFrame, document: str, path: str, type_: str = "string", pos: str = "pos",
                  value: str = "value") -> DataFrame:
    """One row for each element of the array at ``path`` of the VARIANT column ``document``, with its
    position; documents without an array there give no rows."""
    inner = F.try_variant_get(F.col(document).outer(), path, "variant")
    items = df.sparkSession.tvf.variant_explode(F.when(F.schema_of_variant(inner).startswith("ARRAY"), inner))
    return df.lateralJoin(items.select(F.col("pos").alias(pos), F.try_variant_get("value", "$", type_).alias(value)))
