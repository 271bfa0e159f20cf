"""Readers, sinks, fingerprints, task sets and streams on files made here."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sloframe import plugins
from sloframe.operators import datasets
from sloframe.sources import fingerprint, readers, sinks
from sloframe.streaming import monitor


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def logs(tmp_path):
    for model, seed, n in (("m-1", 42, 3), ("m-2", 7, 2)):
        lines = [json.dumps({"step": i, "reward": i / 2}) for i in range(n)]
        write(f"{tmp_path}/{model}/T1/seed_{seed}/train_log.jsonl", [*lines[:1], "", *lines[1:], "{broken"])
    return str(tmp_path)


def test_jsonl_modes_and_run_keys(spark, logs, rows):
    skip = readers.read_logs(spark, logs, "step int, reward double")
    keyed = readers.with_run_keys(skip).groupBy("model", "task", "seed").count()
    assert rows(keyed) == [("m-1", "T1", 42, 3), ("m-2", "T1", 7, 2)]
    report = readers.read_jsonl(spark, logs, "step int, reward double", "report", True, "*.jsonl").cache()
    assert report.where("_corrupt is not null").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, logs, "step int, reward double", "strict", True, "*.jsonl").collect()


def test_numbered_lines_over_many_splits(spark, tmp_path):
    write(f"{tmp_path}/x/a.txt", [f"line {i} " + "y" * 50 for i in range(1, 5001)])
    write(f"{tmp_path}/x/b.txt", ["one", "", "three"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_numbered_lines(spark, f"{tmp_path}/x").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r["line"]: r["value"] for r in got if r["file"].endswith("a.txt")}
    assert len(a) == 5000 and all(v.startswith(f"line {n} ") for n, v in a.items())
    assert sorted((r["line"], r["value"]) for r in got if r["file"].endswith("b.txt")) == [(1, "one"), (2, ""), (3, "three")]


def test_result_document_and_csv(spark, tmp_path, rows):
    doc = {"models": {"m": {"tasks": {"T1": {"acc": 0.5, "n": 3}, "T2": {"acc": 1.0}}}}}
    write(f"{tmp_path}/doc.json", [json.dumps(doc, indent=1)])
    out = readers.read_result_document(spark, f"{tmp_path}/doc.json")
    assert rows(out.select("model", "task", F.col("metrics")["acc"])) == [("m", "T1", 0.5), ("m", "T2", 1.0)]
    write(f"{tmp_path}/r.csv", ["model,steps", "a,500"])
    assert rows(readers.read_csv(spark, f"{tmp_path}/r.csv", "model string, steps int")) == [("a", 500)]


def test_criteria():
    crit = readers.load_criteria('{"slo": {"p95_ms_max": 900}}')
    assert crit["slo"]["p95_ms_max"] == 900 and crit["structure"]["json_valid_min"] == 0.99
    with pytest.raises(ValueError):
        readers.load_criteria('{"slo": {"p96": 1}}')
    assert readers.criteria_hash(crit) != readers.criteria_hash(readers.load_criteria("{}"))
    assert ("slo", "p95_ms", "<=", 900.0) in readers.criteria_thresholds(crit)
    assert readers.first_present({"b": 2.0}, ["a", "b"]) == 2.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b_1", 0.256), ("a", None)], "model string, acc double")
    sinks.write_text_table(df, f"{tmp_path}/md", ["model"], formats={"acc": "%.2f"})
    sinks.write_text_table(df, f"{tmp_path}/dat", ["model"], "series")
    sinks.write_text_table(df, f"{tmp_path}/tex", ["model"], "latex")
    with pytest.raises(ValueError, match="does not belong"):
        sinks.write_text_table(df, f"{tmp_path}/big", ["model"], most=1)
    read = lambda p: [r["value"] for r in spark.read.text(f"{tmp_path}/{p}").collect()]
    assert read("md")[0] == "| model | acc |" and read("md")[-1] == "| b_1 | 0.26 |"
    assert read("dat") == ["model acc", "a nan", "b_1 0.256"]
    assert read("tex")[-1] == r"b\_1 & 0.256 \\"
    sinks.write_jsonl(df, f"{tmp_path}/jl")
    sinks.write_csv(df, f"{tmp_path}/csv")
    sinks.write_parquet(df, f"{tmp_path}/pq", ["model"])
    assert spark.read.json(f"{tmp_path}/jl").count() == spark.read.csv(f"{tmp_path}/csv", header=True).count() == spark.read.parquet(f"{tmp_path}/pq").count() == 2


def test_fingerprints(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, ""), ("c", 3, "x")], "k string, n int, t string")
    fp = lambda d: fingerprint.table_fingerprint(d).collect()[0]["fingerprint"]
    assert fp(df) == fp(df.repartition(3).orderBy(F.desc("k")))
    assert fp(df) != fp(df.na.fill("", ["t"]))
    assert fp(df) != fp(df.union(df.where("k = 'a'")))
    write(f"{tmp_path}/f/a.jsonl", ["{}", "", "[1]"])
    lines = readers.read_numbered_lines(spark, f"{tmp_path}/f")
    got = fingerprint.file_fingerprints(lines, "file", "value").collect()[0]
    assert (got["n_rows"], got["n_bytes"]) == (2, 5)
    write(f"{tmp_path}/s/s.json", ["{}"])
    assert len(fingerprint.small_file_hashes(spark, f"{tmp_path}/s").collect()[0]["sha256"]) == 64
    where = fingerprint.snapshot(df, f"{tmp_path}/snap", "abc")
    assert fingerprint.snapshot(df.limit(0), f"{tmp_path}/snap", "abc") == where
    assert spark.read.parquet(where).count() == 3
    a = spark.createDataFrame([("x", "1")], "k string, fingerprint string")
    b = spark.createDataFrame([("x", "2")], "k string, fingerprint string")
    assert rows(fingerprint.drift(a, b, ["k"]).select("status")) == [("changed",)]
    with pytest.raises(Exception, match="fingerprint drift"):
        fingerprint.require_no_drift(fingerprint.drift(a, b, ["k"])).collect()


def test_balanced_mix_with_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2800, "big").when(F.col("id") < 2990, "mid").otherwise("tiny").alias("g"))
    out = datasets.balanced_mix(df, "g", "id", 500, "oversample", 3).cache()
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()} == {"big": 500, "mid": 500, "tiny": 500}
    assert out.select("id").distinct().count() == 1500
    assert out.where("g = 'tiny' and not id like '%dup%'").count() == 10
    assert datasets.balanced_mix(df, "g", "id", 500, "natural", 3).count() == 3000


def test_expand_and_fill(spark, rows):
    df = spark.createDataFrame([("a", "h Context: x"), ("b", "Context: y")], "id string, prompt string")
    out = rows(datasets.expand_variants(df, "id", "prompt", ["P", "Q"]))
    assert out[0] == ("a_v0", "P\n\nContext: x") and len(out) == 4
    with pytest.raises(Exception, match="marker"):
        datasets.expand_variants(df.withColumn("prompt", F.lit("none")), "id", "prompt", ["P"]).collect()
    ids = [r[0] for r in rows(datasets.cyclic_fill(df.select("id"), "id", [F.col("id")], [F.col("id")], 5))]
    assert sorted(ids) == ["a", "a_x2", "a_x4", "b", "b_x3"]
    assert rows(datasets.cyclic_fill(df.select("id"), "id", [F.col("id")], [F.col("id")], 1)) == [("a",)]


def test_sessions_match_native_windows(spark, rows):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("user"),
        F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(2_000_000))).alias("ts"),
        F.lit(1.0).alias("v"),
    )
    fast = monitor.sessions(df, "ts", "user", 1800, "v")
    native = monitor.sessions_stream(df, "ts", "user", "30 minutes", "v")
    assert rows(fast) == rows(native)


def test_running_baseline_stream_in_several_batches(spark, tmp_path):
    for part in range(3):
        write(f"{tmp_path}/in/{part}.json", [json.dumps({"run": "r", "step": part * 4 + i, "reward": float(i + part)}) for i in (3, 1, 0, 2)])
        os.utime(f"{tmp_path}/in/{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = monitor.tail_logs(spark, f"{tmp_path}/in", "run string, step bigint, reward double", files_per_trigger=1)
    got = sorted((r["step"], r["reward"], r["baseline"]) for r in monitor.running_baseline(stream).collect())
    b = 0.0
    assert len(got) == 12
    for _, reward, base in got:
        assert base == pytest.approx(b)
        b = 0.9 * b + 0.1 * reward


def test_late_rows_are_counted(spark, tmp_path, rows):
    day = lambda n: f"2024-01-{n:02d}T00:00:00"
    for i, days in enumerate(([1, 10], [11], [2])):
        write(f"{tmp_path}/in/{i}.json", [json.dumps({"id": 100 * i + d, "ts": day(d)}) for d in days])
        os.utime(f"{tmp_path}/in/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = monitor.event_time(monitor.tail_logs(spark, f"{tmp_path}/in", "id bigint, ts timestamp", files_per_trigger=1), "ts", "1 day")
    seen = monitor.drain(monitor.drop_replays(stream, ["id"]))
    assert rows(monitor.late_rows(spark.read.schema("id bigint, ts timestamp").json(f"{tmp_path}/in"), seen, ["id"]).select("id")) == [(202,)]


def test_plugins(spark):
    plugins.scorer("twice")(lambda c: c * 2)
    plugins.transform("top")(lambda df: df.where("id > 1"))
    out = plugins.apply_scorers(spark.range(4), {"twice": ("id",)}).transform(plugins.get_transform("top"))
    assert sorted(r["twice"] for r in out.collect()) == [4, 6]
    with pytest.raises(KeyError):
        plugins.get_scorer("nope")
