"""Contracts held as data against the contracts compiled one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sloframe.functions import contract, jsonops
from sloframe.operators import contracts

SCHEMAS = {
    "contact": {
        "type": "object",
        "properties": {"name": {"type": "string"}, "email": {"type": "string", "pattern": r"^[^@\s]+@[^@\s]+$"},
                       "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2}, "n": {"type": "integer", "minimum": -1, "maximum": 2.5},
                       "inner": {"type": "object", "required": ["x", "y"], "properties": {"x": {"enum": [1, "a", None, True]}}}},
        "required": ["name"],
        "additionalProperties": False,
    },
    "tool": {
        "type": "object",
        "properties": {
            "name": {"type": ["string", "null"]},
            "tags": {"type": "array", "items": {"oneOf": [{"type": "string", "pattern": "^t"}, {"type": "object", "required": ["x"]}, {"enum": ["tt", 1]}]}},
            "inner": {"type": "object", "oneOf": [
                {"properties": {"x": {"type": "string"}}, "required": ["x"], "additionalProperties": False},
                {"properties": {"x": {"oneOf": [{"type": "integer"}, {"type": "number"}]}, "y": {"type": "boolean"}}, "required": ["y"]},
            ]},
        },
    },
    "list": {"type": "array", "items": {"type": "array", "items": {"type": "number", "minimum": 0}}},
    "any": {},
    "number": {"oneOf": [{"type": "integer"}, {"type": "number"}]},
}


def record(r):
    scalar = lambda: r.choice([1, 2, 3, -2, 2.5, 1.0, "a", "t1", "tt", "x@y", "", True, False, None])
    value = lambda d: r.choice([scalar, scalar, lambda: [value(d - 1) for _ in range(r.randrange(4))], lambda: {k: value(d - 1) for k in r.sample(["x", "y", "z"], r.randrange(3))}])() if d else scalar()
    if r.random() < 0.15:
        return value(3)
    if r.random() < 0.2:
        return [[scalar() if r.random() < 0.2 else r.random() for _ in range(3)] for _ in range(3)]
    return {k: value(2) for k in r.sample(["name", "email", "tags", "n", "inner", "other"], r.randrange(6))}


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame([(p, json.dumps(s)) for p, s in SCHEMAS.items()], "schema_path string, schema_json string")


def test_against_compiled(spark, schemas):
    r = random.Random(6)
    texts = [json.dumps(record(r)) for _ in range(400)] + ['{"name": "a"', "", "[] []", '{"inner": {"y": true, "x": 3}}', '{"inner": {"y": true, "x": 3.5}}', '{"name": "a", "email": "nope"}']
    rows = [(i, p, t) for p in SCHEMAS for i, t in enumerate(texts)]
    records = spark.createDataFrame(rows, "n int, schema_path string, raw string").repartition(6)
    got = {(x.n, x.schema_path): (x.valid, x.error) for x in contracts.validate(records, schemas, ["n"]).collect()}
    assert len(got) == len(rows)
    seen = set()
    for p, schema in SCHEMAS.items():
        check = contract.compile_contract(schema)(jsonops.parse_strict(F.col("raw"))).alias("c")
        for x in records.where(F.col("schema_path") == p).select("n", "raw", check).collect():
            assert got[x.n, p] == (x.c.valid, x.c.error), (p, x.raw)
            seen.add((p, x.c.error.split(":")[0] if x.c.error else None))
    assert len(seen) > 20


def test_missing_schema_and_odd_rows(spark, schemas):
    rows = [(1, "contact", "{}"), (2, "none", "{}"), (3, None, "{}"), (4, "contact", None), (5, "any", "3"), (6, "none", None)]
    got = {x.n: x.error for x in contracts.validate(spark.createDataFrame(rows, "n int, schema_path string, raw string"), schemas, ["n"]).collect()}
    assert got == {
        1: "<root>: 'name' is a required property", 2: "<root>: no schema for path 'none'", 3: "<root>: no schema for path NULL",
        4: "<root>: not valid JSON", 5: None, 6: "<root>: no schema for path 'none'",
    }
    none = schemas.where("false")
    assert [x.error for x in contracts.validate(spark.createDataFrame(rows[:1], "n int, schema_path string, raw string"), none, ["n"]).collect()] == ["<root>: no schema for path 'contact'"]
    assert contracts.validate(spark.createDataFrame([], "n int, schema_path string, raw string"), schemas, ["n"]).collect() == []


def test_rules_of_a_schema(spark, schemas):
    rules = contracts.rule_table(schemas.where("schema_path = 'contact'")).select("where", "keyword", F.to_json("operand").alias("o")).collect()
    found = {(tuple(x.where), x.keyword, x.o) for x in rules}
    assert ((), None, None) in found and (("tags", contracts.ITEM), "type", '"string"') in found and (("inner",), "required", '"y"') in found
    assert ((), "additionalProperties", '["email","inner","n","name","tags"]') in found


def test_bad_schemas(spark):
    make = lambda t: spark.createDataFrame([("p", t)], "schema_path string, schema_json string")
    records = spark.createDataFrame([(1, "p", "{}")], "n int, schema_path string, raw string")
    for text in ("{", '{"type": "thing"}'):
        with pytest.raises(Exception, match="MALFORMED_RECORD|unsupported type"):
            contracts.validate(records, make(text), ["n"]).collect()
