"""Strict JSON on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sloframe.functions.binding import let

# Fixed value: objects with at most one level of nested braces inside other text.
# Possessive loops, so that a text with very many objects needs no deep stack.
EMBEDDED_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
FENCE = "```"


# Fixed value: what any JSON text must start and end with. Text that fails this
# is not handed to the parser, whose failures are costly.
JSON_SHAPE = r"(?s)^\s*[{\[\"tfn0-9-].*[}\]\"el0-9]\s*$|^\s*[0-9]\s*$"


def _wrapped(text: Column) -> Column:
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.rlike(text, F.lit(JSON_SHAPE)), parsed)


def parse_strict(text: Column) -> Column:
    """VARIANT of the text, or NULL unless the *whole* text is one JSON value.

    ``try_parse_json`` alone ignores what follows the first value, so the text is
    parsed as the only element of an array.
    """
    return let(_wrapped(text), lambda v: F.when(F.size(v) == 1, v[0]))


def is_json(text: Column) -> Column:
    return F.coalesce(F.size(_wrapped(text)) == 1, F.lit(False))


def kind(value: Column) -> Column:
    """Type name of a VARIANT: STRING, BIGINT, DECIMAL(..), OBJECT<..>, VOID for
    JSON null, or NULL when the value is missing."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    # A struct without fields: nothing of the object is copied for the test.
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_number(value: Column) -> Column:
    return F.coalesce(F.rlike(kind(value), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), F.lit(False))


def field(value: Column, name: str) -> Column:
    """VARIANT field by name; NULL when missing or not an object."""
    return F.try_variant_get(value, "$[" + _quoted(name) + "]", "variant")


def _quoted(name: str) -> str:
    return "'" + name + "'" if "'" not in name else '"' + name + '"'


def text_of(value: Column) -> Column:
    """Scalar as text, objects and arrays as JSON, NULL for missing and null."""
    return F.try_variant_get(value, "$", "string")


def canonical(text: Column) -> Column:
    """Sorted keys, no white space; empty text for NULL, broken or empty input."""
    out = F.to_json(parse_strict(text))
    return F.when(out.isNull() | out.isin("{}", "[]", "null"), F.lit("")).otherwise(out)


def as_map(value: Column) -> Column:
    """MAP<STRING,VARIANT> of an object, empty for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def as_array(value: Column) -> Column:
    """ARRAY<VARIANT> of an array, empty for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def extract_object(text: Column, fallback: Column | None = None) -> Column:
    """JSON text found in noisy output: the whole text, else the first fenced
    block that parses, else the first embedded object that parses, else fallback.

    The candidates are tried as one array, so the text is scanned once per form.
    """
    unlabelled = lambda part: F.regexp_replace(F.regexp_replace(part, r"^\s*(?:json)?\s*", ""), r"\s+$", "")
    fenced = F.when(
        F.contains(text, F.lit(FENCE)),
        F.filter(F.transform(F.split(text, FENCE), unlabelled), lambda part: part != ""),
    ).otherwise(F.array().cast("array<string>"))
    embedded = F.regexp_extract_all(text, F.lit(EMBEDDED_OBJECT), 0)
    found = F.try_element_at(F.filter(F.concat(F.array(text), fenced, embedded), is_json), F.lit(1))
    return F.coalesce(found, fallback if fallback is not None else F.lit("{}"))
