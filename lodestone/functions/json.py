"""What a JSON text is, by Spark's variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more. The parser stops after a value, so that the text is also parsed
    within brackets and within braces: what follows a value would have to close both at once."""
    within = [text, F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))]
    return F.array_min(F.array(*[F.try_parse_json(t).isNotNull() for t in within]))


def json_kind(text: Column) -> Column:
    """object, array, scalar, null or broken; null for a null text."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(text.isNull(), F.lit(None)).when(~whole(text), "broken").when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").otherwise("scalar")
    )


def object_or_null(text: Column) -> Column:
    """The text's JSON object as a variant; null for arrays, scalars, null and broken texts."""
    return F.when(json_kind(text) == "object", F.try_parse_json(text))
