"""JSON-Schema contracts compiled to Columns over VARIANT.

Keywords: type, properties, required, additionalProperties (false), enum,
items, minItems, maxItems, minimum, maximum, pattern, oneOf. A schema becomes
one array of messages per record, built on the driver once; the check runs JVM-side.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sloframe.functions.binding import let
from sloframe.functions.jsonops import as_array, as_map, field, is_array, is_number, is_object, kind

Rule = tuple[Column, Column]  # (broken?, message)


def _typed(value: Column, name: str) -> Column:
    k = kind(value)
    if name == "object":
        return is_object(value)
    if name == "array":
        return is_array(value)
    if name == "string":
        return F.coalesce(k == "STRING", F.lit(False))
    if name == "boolean":
        return F.coalesce(k == "BOOLEAN", F.lit(False))
    if name == "null":
        return F.coalesce(k == "VOID", F.lit(False))
    if name == "number":
        return is_number(value)
    if name == "integer":
        number = F.try_variant_get(value, "$", "double")
        return is_number(value) & F.coalesce(number == F.floor(number), F.lit(False))
    raise ValueError(f"unsupported type {name!r}")


def _is_type(value: Column, declared: str | list[str]) -> Column:
    out = F.lit(False)
    for name in [declared] if isinstance(declared, str) else declared:
        out = out | _typed(value, name)
    return out


def _shown(value: Column) -> Column:
    """Value as an error message prints it."""
    return F.when(kind(value) == "STRING", F.concat(F.lit("'"), value.cast("string"), F.lit("'"))).otherwise(
        F.to_json(value)
    )


def _equals(value: Column, literal: object) -> Column:
    if isinstance(literal, bool):
        same = (kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(literal))
    elif isinstance(literal, (int, float)):
        same = is_number(value) & (F.try_variant_get(value, "$", "double") == F.lit(float(literal)))
    elif isinstance(literal, str):
        same = (kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(literal))
    elif literal is None:
        same = kind(value) == "VOID"
    else:
        same = F.to_json(value) == F.lit(json.dumps(literal, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return F.coalesce(same, F.lit(False))


def _own_rules(value: Column, schema: dict) -> list[Rule]:
    """Rules about the value itself (not about its fields)."""
    rules: list[Rule] = []
    if "type" in schema:
        declared = schema["type"]
        text = f"'{declared}'" if isinstance(declared, str) else ", ".join(f"'{d}'" for d in declared)
        rules.append((~_is_type(value, declared), F.concat(_shown(value), F.lit(f" is not of type {text}"))))
    if "enum" in schema:
        texts = [x for x in schema["enum"] if isinstance(x, str)]
        inside = F.coalesce((kind(value) == "STRING") & F.try_variant_get(value, "$", "string").isin(texts), F.lit(False)) if texts else F.lit(False)
        for literal in schema["enum"]:
            if not isinstance(literal, str):
                inside = inside | _equals(value, literal)
        rules.append((~inside, F.concat(_shown(value), F.lit(f" is not one of {schema['enum']!r}"))))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        rules.append((is_number(value) & (number < schema["minimum"]),
                      F.concat(_shown(value), F.lit(f" is less than the minimum of {schema['minimum']}"))))
    if "maximum" in schema:
        rules.append((is_number(value) & (number > schema["maximum"]),
                      F.concat(_shown(value), F.lit(f" is greater than the maximum of {schema['maximum']}"))))
    if "pattern" in schema:
        text = F.try_variant_get(value, "$", "string")
        rules.append(((kind(value) == "STRING") & ~F.rlike(text, F.lit(schema["pattern"])),
                      F.concat(_shown(value), F.lit(f" does not match {schema['pattern']!r}"))))
    if "minItems" in schema:
        rules.append((is_array(value) & (F.size(as_array(value)) < schema["minItems"]),
                      F.concat(_shown(value), F.lit(" is too short"))))
    if "maxItems" in schema:
        rules.append((is_array(value) & (F.size(as_array(value)) > schema["maxItems"]),
                      F.concat(_shown(value), F.lit(" is too long"))))
    for name in schema.get("required", []):
        rules.append((field(value, name).isNull() & is_object(value), F.lit(f"'{name}' is a required property")))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>")
        unknown = F.array_except(F.map_keys(as_map(value)), known)
        extra = F.array_sort(unknown)
        rules.append((F.size(unknown) > 0, F.concat(
            F.lit("Additional properties are not allowed ("),
            F.array_join(F.transform(extra, lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", "),
            F.when(F.size(extra) == 1, F.lit(" was unexpected)")).otherwise(F.lit(" were unexpected)")),
        )))
    if "oneOf" in schema:
        hits = sum((valid(value, branch).cast("int") for branch in schema["oneOf"]), F.lit(0))
        rules.append((hits != 1, F.when(hits == 0, F.concat(_shown(value), F.lit(" is not valid under any of the given schemas")))
                      .otherwise(F.concat(_shown(value), F.lit(" is valid under more than one of the given schemas")))))
    return rules


def violations(value: Column, schema: dict, path: tuple[str, ...] = ()) -> Column:
    """All messages as ``path: message``; rules of the value come before its fields."""
    prefix = ".".join(path) if path else "<root>"
    none = F.array().cast("array<string>")

    def own(v: Column) -> Column:
        rules = [F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(prefix + ": "), msg)) for bad, msg in _own_rules(v, schema)]
        return F.array_compact(F.array(*rules)) if rules else none

    def nested(v: Column) -> list[Column]:
        parts = []
        for name in sorted(schema.get("properties", {})):
            inner = schema["properties"][name]
            parts.append(let(field(v, name), lambda c, n=name, i=inner: F.when(c.isNotNull(), violations(c, i, (*path, n))).otherwise(none)))
        if "items" in schema:
            parts.append(F.flatten(F.transform(as_array(v), item)))
        return parts

    def item(v: Column, index: Column) -> Column:
        # Positions are known only at run time, so the path prefix is added here.
        at = F.concat(F.lit("" if not path else prefix + "."), index.cast("string"))
        return F.transform(violations(v, schema["items"], ("{i}",)), lambda m: F.concat(at, F.substring(m, F.lit(4), F.length(m))))

    return F.concat(own(value), *nested(value))


def valid(value: Column, schema: dict) -> Column:
    """True when the value is present and breaks no rule."""
    ok = value.isNotNull()
    for bad, _ in _own_rules(value, schema):
        ok = ok & ~F.coalesce(bad, F.lit(False))
    for name, inner in schema.get("properties", {}).items():
        ok = ok & let(field(value, name), lambda c, i=inner: c.isNull() | valid(c, i))
    if "items" in schema:
        ok = ok & F.forall(as_array(value), lambda x: valid(x, schema["items"]))
    return ok


def _first(value: Column, schema: dict, path: tuple[str, ...] = ()) -> Column:
    """The first of the ``violations``; what comes after it is not evaluated."""
    prefix = ".".join(path) if path else "<root>"
    found = [F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(prefix + ": "), msg)) for bad, msg in _own_rules(value, schema)]
    for name in sorted(schema.get("properties", {})):
        inner = schema["properties"][name]
        found.append(let(field(value, name), lambda c, n=name, i=inner: F.when(c.isNotNull(), _first(c, i, (*path, n)))))
    if "items" in schema:
        before = "" if not path else prefix + "."
        item = lambda v, at: F.concat(F.lit(before), at.cast("string"), F.substr(_first(v, schema["items"], ("{i}",)), F.lit(4)))
        found.append(F.try_element_at(F.array_compact(F.transform(as_array(value), item)), F.lit(1)))
    return F.coalesce(F.lit(None).cast("string"), *found)


def first_violation(value: Column, schema: dict) -> Column:
    """First message, or NULL for a valid record; an unparsed value is an error."""
    return let(value, lambda v: F.when(v.isNull(), F.lit("<root>: not valid JSON")).otherwise(_first(v, schema)))


def compile_contract(schema: dict | str) -> Callable[[Column], Column]:
    """Column builder: VARIANT -> struct(valid, error)."""
    parsed = json.loads(schema) if isinstance(schema, str) else schema

    def check(value: Column) -> Column:
        return let(first_violation(value, parsed), lambda e: F.struct(e.isNull().alias("valid"), e.alias("error")))

    return check
