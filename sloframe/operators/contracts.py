"""Contracts held as data: every record is checked against the schema that its path names.

Schemas are rows of a table. They are flattened into rules (where, keyword, operand, place in
the order of errors), records into nodes (where, value), and a record's errors come from the
join of the two on schema path and place. One plan checks any number of schemas; the rules
travel to the records, and only one row per record and task is shuffled to find its first
error. The keywords and messages are those of ``functions.contract``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.functions import contract
from sloframe.functions.binding import let
from sloframe.functions.jsonops import as_array, as_map, field, is_array, is_number, is_object, kind, parse_strict

ITEM = "\x00"  # stands for any position of an array
DEEPEST = 64

# Own rules of a value come before its fields; this is their order.
_PLACES = ("type", "enum", "minimum", "maximum", "pattern", "minItems", "maxItems")
_ADDITIONAL, _ONE_OF, _OWN = 1_000_000, 1_000_001, -2_000_000


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _escaped(text: Column) -> Column:
    return _quoted(F.replace(text, F.lit("\\"), F.lit("\\\\")))


def _owner() -> Column:
    """Id of a ``oneOf`` at ``where`` inside the branch that ``chain`` ends with."""
    last = lambda name: F.try_element_at(f"chain.{name}", F.lit(-1)).cast("string")
    return F.concat_ws("/", last("owner"), last("branch"), F.to_json("where"))


def _listed(value: Column) -> Column:
    """A list as error messages print it."""
    scalar = lambda v: (
        F.when(kind(v) == "STRING", _escaped(v.cast("string")))
        .when(kind(v) == "VOID", F.lit("None"))
        .when(kind(v) == "BOOLEAN", F.initcap(F.to_json(v)))
        .otherwise(F.to_json(v))
    )
    return F.concat(F.lit("["), F.array_join(F.transform(as_array(value), scalar), ", "), F.lit("]"))


def _as_list(value: Column) -> Column:
    """An array as it is, anything else as its only element."""
    return F.when(is_array(value), as_array(value)).otherwise(F.array(value))


def _tail(keyword: str, operand: Column) -> Column:
    """The part of a message that follows the value."""
    return {
        "type": F.concat(F.lit(" is not of type "), F.array_join(F.transform(_as_list(operand), lambda t: _quoted(t.cast("string"))), ", ")),
        "enum": F.concat(F.lit(" is not one of "), _listed(operand)),
        "minimum": F.concat(F.lit(" is less than the minimum of "), F.to_json(operand)),
        "maximum": F.concat(F.lit(" is greater than the maximum of "), F.to_json(operand)),
        "pattern": F.concat(F.lit(" does not match "), _escaped(operand.cast("string"))),
        "minItems": F.lit(" is too short"),
        "maxItems": F.lit(" is too long"),
    }[keyword]


def _rules(schema: Column) -> Column:
    """Rules of one schema node about the value itself."""

    def rule(keyword: str, operand: Column, place: Column, tail: Column) -> Column:
        return F.struct(F.lit(keyword).alias("keyword"), operand.alias("operand"), place.cast("bigint").alias("place"), tail.alias("tail"))

    own = [
        let(field(schema, k), lambda o, k=k, i=i: F.when(o.isNotNull(), rule(k, o, F.lit(i), _tail(k, o))))
        for i, k in enumerate(_PLACES)
    ]
    required = F.transform(as_array(field(schema, "required")), lambda name, i: rule("required", name, i + len(_PLACES), F.lit(None).cast("string")))
    known = F.to_variant_object(F.map_keys(as_map(field(schema, "properties"))))
    closed = F.when(F.try_variant_get(schema, "$.additionalProperties", "string") == "false", rule("additionalProperties", known, F.lit(_ADDITIONAL), F.lit(None).cast("string")))
    branches = field(schema, "oneOf")
    one_of = F.when(branches.isNotNull(), rule("oneOf", branches, F.lit(_ONE_OF), F.lit(None).cast("string")))
    return F.concat(F.array_compact(F.array(*own)), required, F.array_compact(F.array(closed, one_of)))


def rule_table(schemas: DataFrame, path: str = "schema_path", text: str = "schema_json") -> DataFrame:
    """The rules of all schemas, one row each.

    ``where`` is the path of the value (``ITEM`` for the positions of an array), ``ranks`` its
    place among its parent's children at each step, and ``chain`` the ``oneOf`` branches that
    the rule stands in: the owner's id, the branch and the length of the owner's path. Every
    schema has a row without keyword at its root. A text that is not JSON is an error. The
    table holds a row per schema file; each round goes one level down.
    """
    where, ranks = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    level = schemas.select(
        F.col(path).alias("schema_path"), F.parse_json(F.col(text)).alias("schema"), where.alias("where"), ranks.alias("ranks"),
        F.array().cast("array<struct<owner:string,branch:int,len:int>>").alias("chain"),
    )
    keep = ["schema_path", "where", "ranks", "chain"]
    none = [F.lit(None).cast(t).alias(n) for n, t in (("keyword", "string"), ("operand", "variant"), ("place", "bigint"), ("tail", "string"))]
    rules = level.select(*keep, *none)
    for _ in range(DEEPEST):
        rules = rules.unionByName(level.select(*keep, F.inline(_rules(F.col("schema")))))
        properties = as_map(field(F.col("schema"), "properties"))
        owner = _owner()
        child = lambda schema, seg, rank, chain: F.struct(
            schema.alias("schema"), F.when(seg.isNotNull(), F.array_append("where", seg)).otherwise(F.col("where")).alias("where"),
            F.when(seg.isNotNull(), F.array_append("ranks", rank.cast("bigint"))).otherwise(F.col("ranks")).alias("ranks"), chain.alias("chain"),
        )
        fields = F.transform(F.array_sort(F.map_keys(properties)), lambda name, i: child(properties[name], name, i, F.col("chain")))
        item = field(F.col("schema"), "items")
        items = F.when(item.isNotNull(), F.array(child(item, F.lit(ITEM), F.size(properties), F.col("chain"))))
        branch = lambda schema, i: child(
            schema, F.lit(None).cast("string"), F.lit(0),
            F.array_append("chain", F.struct(owner.alias("owner"), i.alias("branch"), F.size("where").alias("len"))),
        )
        branches = F.transform(as_array(field(F.col("schema"), "oneOf")), branch)
        below = F.flatten(F.array_compact(F.array(fields, items, branches)))
        level = level.select("schema_path", F.explode(below).alias("c")).select("schema_path", "c.*")
        if level.isEmpty():
            return rules
    raise ValueError(f"a schema is nested more than {DEEPEST} levels deep")


def _nodes(value: Column, depth: int) -> Column:
    """The value and what it holds down to ``depth``: where, shown path, positions, value."""
    empty = F.array().cast("array<string>")

    def node(parent: Column, seg: Column, shown: Column, at: Column, v: Column) -> Column:
        return F.struct(
            F.array_append(parent["where"], seg).alias("where"), F.array_append(parent["shown"], shown).alias("shown"),
            F.array_append(parent["at"], at.cast("bigint")).alias("at"), v.alias("value"),
        )

    def children(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda n: F.concat(
            F.transform(F.map_entries(as_map(n["value"])), lambda e: node(n, e["key"], e["key"], F.lit(0), e["value"])),
            F.transform(as_array(n["value"]), lambda v, i: node(n, F.lit(ITEM), i.cast("string"), i, v)),
        )))

    def down(nodes: Column, left: int) -> Column:
        return nodes if not left else let(children(nodes), lambda c: F.concat(nodes, down(c, left - 1)))

    root = F.array(F.struct(empty.alias("where"), empty.alias("shown"), F.array().cast("array<bigint>").alias("at"), value.alias("value")))
    return let(root, lambda r: down(r, depth))


def _equal(value: Column, literal: Column) -> Column:
    number, same_kind = "double", kind(value) == kind(literal)
    return F.coalesce(
        F.when(is_number(value) & is_number(literal), F.try_variant_get(value, "$", number) == F.try_variant_get(literal, "$", number))
        .when(is_number(value) | is_number(literal), F.lit(False))
        .otherwise((same_kind | is_array(value) | is_object(value)) & (F.to_json(value) == F.to_json(literal))),
        F.lit(False),
    )


def _typed(value: Column, name: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unsupported type "), name)).cast("boolean")
    for t in ("object", "array", "string", "boolean", "null", "number", "integer"):
        out = F.when(name == t, contract._typed(value, t)).otherwise(out)
    return out


def _broken(value: Column, keyword: Column, operand: Column) -> Column:
    number, limit = F.try_variant_get(value, "$", "double"), F.try_variant_get(operand, "$", "double")
    text = F.try_variant_get(operand, "$", "string")
    held = as_map(value)
    checks = {
        "type": ~F.exists(_as_list(operand), lambda t: _typed(value, t.cast("string"))),
        "enum": ~F.exists(as_array(operand), lambda o: _equal(value, o)),
        "minimum": is_number(value) & (number < limit),
        "maximum": is_number(value) & (number > limit),
        "pattern": (kind(value) == "STRING") & ~F.rlike(F.try_variant_get(value, "$", "string"), text),
        "minItems": is_array(value) & (F.size(as_array(value)) < limit),
        "maxItems": is_array(value) & (F.size(as_array(value)) > limit),
        "required": is_object(value) & ~F.map_contains_key(held, text),
        "additionalProperties": F.size(_extra(value, operand)) > 0,
    }
    out = F.lit(False)
    for k, c in checks.items():
        out = F.when(keyword == k, F.coalesce(c, F.lit(False))).otherwise(out)
    return out


def _extra(value: Column, known: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(as_map(value)), F.transform(as_array(known), lambda k: k.cast("string"))))


def _message(value: Column, keyword: Column, operand: Column, tail: Column) -> Column:
    extra = _extra(value, operand)
    many = F.when(F.size(extra) == 1, F.lit(" was unexpected)")).otherwise(F.lit(" were unexpected)"))
    return (
        F.when(keyword == "required", F.concat(_quoted(F.try_variant_get(operand, "$", "string")), F.lit(" is a required property")))
        .when(keyword == "additionalProperties", F.concat(F.lit("Additional properties are not allowed ("), F.array_join(F.transform(extra, _quoted), ", "), many))
        .otherwise(F.concat(contract._shown(value), tail))
    )


def validate(records: DataFrame, schemas: DataFrame, key: Sequence[str], text: str = "raw", path: str = "schema_path", schema_text: str = "schema_json") -> DataFrame:
    """``key``, ``path``, ``valid`` and ``error`` (``path: message``, the first by the order of the
    rules) of each record, checked against the schema of its own path.

    ``key`` tells records apart. A text that is not one JSON value and a path without a schema
    (also a NULL one) are errors of their own, the missing schema first. Rules of a ``oneOf``
    branch count against the branch; the value breaks the ``oneOf`` unless exactly one branch
    has no broken rule, and branches are counted from the innermost ``oneOf`` outwards.
    """
    from sloframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(records.sparkSession)
    rules = rule_table(schemas, path, schema_text).checkpoint()  # read for its depths and for the join
    depths = rules.agg(F.max(F.size("where")).alias("where"), F.max(F.size("chain")).alias("chain")).first()
    key = list(key)
    parsed = records.select(*key, F.col(path).alias("__path"), parse_strict(F.col(text)).alias("__value"))
    nodes = parsed.select(*key, "__path", F.explode(_nodes(F.col("__value"), depths["where"] or 0)).alias("__n")).select(*key, "__path", "__n.*")
    right = rules.withColumnsRenamed({"schema_path": "__rule_path", "where": "__where"})
    met = nodes.join(right, (F.col("__path") == F.col("__rule_path")) & (F.col("where") == F.col("__where")), "left")
    value, keyword, operand = F.col("value"), F.col("keyword"), F.col("operand")
    root = F.size("where") == 0
    met = met.where(F.col("__rule_path").isNotNull() | root)

    # The place of an error: ranks and positions down to its value, then the rule's own place.
    steps = F.concat(F.zip_with("ranks", "at", lambda r, i: r + i), F.array(F.col("place") + _OWN))
    at = F.when(root, F.lit("<root>")).otherwise(F.array_join("shown", "."))
    said = lambda order, message: F.struct(order.cast("array<bigint>").alias("order"), message.alias("message"))
    general = lambda i, message: said(F.array(F.lit(2 * _OWN + i)), message)
    error = (
        F.when(F.col("__rule_path").isNull(), general(0, F.concat(F.lit("<root>: no schema for path "), F.coalesce(_quoted(F.col("__path")), F.lit("NULL")))))
        .when(value.isNull(), F.when(keyword.isNull(), general(1, F.lit("<root>: not valid JSON"))))
        .when(_broken(value, keyword, operand), said(steps, F.concat(at, F.lit(": "), _message(value, keyword, operand, F.col("tail")))))
    )
    chain = F.coalesce("chain", F.array().cast("array<struct<owner:string,branch:int,len:int>>"))
    is_choice = keyword.eqNullSafe(F.lit("oneOf")) & value.isNotNull()
    owner = _owner()
    shown_value = F.concat(at, F.lit(": "), contract._shown(value))
    choice = F.when(is_choice, F.struct(owner.alias("owner"), F.size(as_array(operand)).alias("k"), steps.alias("order"), shown_value.alias("said")))
    rows = met.select(*key, "__path", chain.alias("chain"), "shown", error.alias("error"), choice.alias("choice"))

    for depth in range(depths["chain"] or 0, 0, -1):
        rows = _chosen(rows, [*key, "__path"], depth)
    out = rows.groupBy(*key, "__path").agg(F.min("error").alias("error"))
    return out.select(*key, F.col("__path").alias(path), F.col("error").isNull().alias("valid"), F.col("error.message").alias("error"))


def _chosen(rows: DataFrame, key: list[str], depth: int) -> DataFrame:
    """Count the branches of ``oneOf`` rules ``depth`` deep that have a broken rule, and turn each
    such ``oneOf`` into a plain error, or none, one level further out."""
    inside = F.size("chain") == depth
    last = F.element_at("chain", depth)
    here = F.col("choice").isNotNull() & (F.size("chain") == depth - 1)
    owner = F.when(inside, last["owner"]).when(here, F.col("choice.owner"))
    anchor = F.when(inside, F.slice("shown", 1, last["len"])).when(here, F.col("shown"))
    # Deeper choices were settled before; choices further out wait as rows of their own.
    waiting = F.when(~here & ~inside, F.col("choice"))
    outer = F.when(inside, F.slice("chain", 1, depth - 1)).otherwise(F.col("chain"))
    grouped = rows.select(
        *key, outer.alias("chain"), F.coalesce(anchor, F.col("shown")).alias("shown"), owner.alias("owner"),
        F.when(waiting.isNotNull(), waiting["owner"]).alias("waits"), waiting.alias("choice"),
        F.when(here, F.col("choice")).alias("settled"),
        F.when(inside & F.col("error").isNotNull(), last["branch"]).alias("failed"), F.when(~inside, F.col("error")).alias("error"),
    ).groupBy(*key, "chain", "shown", "owner", "waits").agg(
        F.max("choice").alias("choice"), F.max("settled").alias("settled"), F.count_distinct("failed").alias("failed"), F.min("error").alias("error"),
    )
    hits = F.col("settled.k") - F.col("failed")
    message = F.concat(F.col("settled.said"), F.when(hits == 0, F.lit(" is not valid under any of the given schemas")).otherwise(F.lit(" is valid under more than one of the given schemas")))
    broken = F.when(F.col("settled").isNotNull() & (hits != 1), F.struct(F.col("settled.order").alias("order"), message.alias("message")))
    return grouped.select(*key, "chain", "shown", F.coalesce("error", broken).alias("error"), "choice")
