"""Ordered exports, manifests, samples and shuffles against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sloframe.operators import datasets
from sloframe.sources import manifest, sinks


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_ordered_lines_over_many_files(spark, folder):
    r = random.Random(1)
    rows = [(i, r.choice([1.5, 2.0, None]), f"n_{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, v double, s string").repartition(9)
    path = f"{folder}/out"
    listing = sinks.write_ordered_lines(df, path, [F.desc_nulls_last("v"), F.asc("i")], formats={"v": "%.2f"}).collect()
    assert sum(x.n for x in listing) == 5000 and len(listing) > 3
    assert [x.first for x in listing] == [sum(y.n for y in listing[:k]) for k in range(len(listing))]
    got = [x.value for x in sinks.read_ordered_lines(spark, path).orderBy("number").collect()]
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == ["i v s"] + [f"{i} {'nan' if v is None else f'{v:.2f}'} {s}" for i, v, s in order]


def test_ordered_lines_of_nothing(spark, folder):
    df = spark.createDataFrame([], "a int, b int")
    sinks.write_ordered_lines(df, f"{folder}/out", ["a"], "latex")
    assert [x.value for x in sinks.read_ordered_lines(spark, f"{folder}/out").collect()] == [r"a & b \\"]


def lines(spark, files):
    rows = [(f, i + 1, t) for f, ts in files.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "file string, line bigint, value string").repartition(6)


def test_tree_is_the_same_for_any_partitioning(spark):
    files = {"a": [f"line {i}" for i in range(205)], "b": ["x"], "c": ["", "", ""]}
    one = manifest.line_tree(lines(spark, files), fanout=5)
    two = manifest.line_tree(lines(spark, files).coalesce(1), fanout=5)
    assert sorted(one.collect()) == sorted(two.collect())
    assert {(x.file, x.n_lines, x.n_bytes) for x in manifest.file_manifest(one).collect()} == {("a", 205, sum(map(len, files["a"]))), ("b", 1, 1), ("c", 3, 0)}
    block = one.where("file = 'a' and level = 0 and node = 3").first()
    assert (block.first_line, block.last_line) == (16, 20)
    assert block.digest == hashlib.sha256("".join(hashlib.md5(t.encode()).hexdigest() for t in files["a"][15:20]).encode()).hexdigest()
    swapped = {**files, "c": ["", "x", ""]}
    assert manifest.file_manifest(one).join(manifest.file_manifest(manifest.line_tree(lines(spark, swapped), fanout=5)), ["file", "digest"], "left_anti").collect()[0].file == "c"


def test_drift_is_traced_to_blocks(spark):
    old = {"a": [f"{i}" for i in range(400)], "b": [f"{i}" for i in range(30)], "c": ["x"] * 12, "d": ["gone"]}
    new = {"a": [t if i not in (7, 8, 399) else "other" for i, t in enumerate(old["a"])], "b": old["b"], "c": ["x"] * 13, "e": ["more"] * 6}
    trace = manifest.trace_drift(manifest.line_tree(lines(spark, new), fanout=4), manifest.line_tree(lines(spark, old), fanout=4), fanout=4)
    got = sorted((x.file, x.status, x.first_line, x.last_line) for x in trace.collect())
    assert got == [("a", "changed", 5, 8), ("a", "changed", 9, 12), ("a", "changed", 397, 400), ("c", "changed", 13, 13), ("d", "missing", 1, 1), ("e", "new", 1, 4), ("e", "new", 5, 6)]
    with pytest.raises(ValueError, match="changed file a: lines 5 to 8"):
        manifest.require_no_trace(trace)
    same = manifest.line_tree(lines(spark, old), fanout=4)
    manifest.require_no_trace(manifest.trace_drift(same, same, fanout=4))


def test_drift_of_files_that_grew_by_levels(spark):
    old, new = {"a": ["x"] * 3, "b": ["y"] * 3}, {"a": ["x"] * 300, "b": ["y"] * 3}
    trace = manifest.trace_drift(manifest.line_tree(lines(spark, new), fanout=4), manifest.line_tree(lines(spark, old), fanout=4), fanout=4)
    got = sorted((x.file, x.first_line, x.last_line) for x in trace.collect())
    assert got[0] == ("a", 1, 4) and got[-1] == ("a", 297, 300) and len(got) == 75


@pytest.mark.parametrize("n", [0, 1, 700, 1999, 5000])
def test_sample_and_shuffle(spark, n):
    df = spark.range(2000).withColumnRenamed("id", "k").repartition(7)
    order = sorted(range(2000), key=lambda k: (hashlib.md5(f"3|{k}".encode()).hexdigest(), k))
    assert sorted(r.k for r in datasets.sample_n(df, "k", n, 3).collect()) == sorted(order[:n])
    if n == 700:
        assert [r.k for r in datasets.shuffled(df, "k", 3).orderBy("place").collect()] == order
        assert datasets.largest_group(df.withColumn("g", F.col("k") % 3), "g") == 667
        assert datasets.sample_n(df.where("false"), "k", 5, 3).collect() == [] and datasets.largest_group(df.where("false"), "k") == 0


def test_many_logs_side_by_side(spark):
    from sloframe.operators.joins import positional_many

    make = lambda *rows: spark.createDataFrame(list(rows), "g string, line int, v string")
    logs = [make(("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")), make(("a", 1, None), ("a", 2, "z"), (None, 1, "m")), make(("a", 1, "w"), (None, 1, "o"), (None, 1, "again"))]
    got = {(r.g, r.line): r["values"] for r in positional_many(logs, ["g"], "line", "v").collect()}
    assert got == {("a", 1): ["x", None, "w"]}
    assert {(r.g, r.line): r["values"] for r in positional_many(logs[:2], ["g"], "line", "v").collect()}[None, 1] == ["n", "m"]


def test_levels_at_every_deadline(spark):
    from sloframe.operators import gates

    row = {"m": "a", "json_valid_rate": 1.0, "schema_valid_rate": 0.95, "p95_latency_ms": 2500.0, "p99_latency_ms": 2600.0, "success_at_slo": 0.95, "faithfulness": 0.9, "disagreement": 0.05, "function_calling": 0.9, "routing": 0.95}
    rows = [row, {**row, "m": "b", "faithfulness": None}, {**row, "m": "c", "json_valid_rate": 0.5}]
    got = {(r.m, r.slo_tier): r.highest_tier for r in gates.certification(spark.createDataFrame(rows), ["m"]).collect()}
    assert [got["a", t] for t in gates.CERTIFICATION_LIMITS] == ["none", "gold", "gold"]
    assert {got["b", t] for t in ("standard", "batch")} == {"bronze"} and {got["c", t] for t in gates.CERTIFICATION_LIMITS} == {"none"}
