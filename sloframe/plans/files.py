"""Queries that go through files: a driver table is written, read back and reduced."""

from __future__ import annotations

import gzip
import json
import uuid

from pyspark.sql import functions as F

from sloframe import plugins
from sloframe.operators import curves, gates
from sloframe.operators.ordered import attach
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import EPISODES_SQL, episodes, table
from sloframe.session import ensure_checkpoint_dir
from sloframe.sources import fingerprint, manifest, quarantine, readers, sinks


def _folder(spark) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _event_lines(spark, d):
    """Events as JSON lines; every 50th line is blank and every 50th is cut short."""
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    kind = F.col("event_id") % 50
    return table(spark, d, "events").select("event_id", F.when(kind == 0, "").when(kind == 1, F.substring(whole, 1, 12)).otherwise(whole).alias("value"))


_EVENT = "event_id bigint, event_type string, value double"


@query("jsonl_skip", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 50 > 1 GROUP BY event_type")
def jsonl_skip(spark, d):
    path = _folder(spark)
    _event_lines(spark, d).select("value").write.text(path)
    e = readers.read_jsonl(spark, path, _EVENT, "skip")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("jsonl_report", "SELECT count(*) FILTER (WHERE event_id % 50 > 1) AS good, count(*) FILTER (WHERE event_id % 50 = 1) AS corrupt FROM events")
def jsonl_report(spark, d):
    path = _folder(spark)
    _event_lines(spark, d).select("value").write.text(path)
    e = readers.read_jsonl(spark, path, _EVENT, "report")
    bad = F.col(readers.CORRUPT).isNotNull()
    return e.agg(F.count_if(F.col("event_id").isNotNull() & ~bad).alias("good"), F.count_if(bad).alias("corrupt"))


@query(
    "log_folders",
    "SELECT 'model' || (event_id % 2) AS model, 'T' || (event_id % 4 // 2) AS task, CAST(event_id % 4 AS INT) AS seed, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 50 > 1 GROUP BY ALL",
)
def log_folders(spark, d):
    """Logs under ``model/task/seed_N``, found by their path."""
    root = _folder(spark)
    for i in range(4):
        _event_lines(spark, d).where(F.col("event_id") % 4 == i).select("value").write.option("lineSep", "\n").text(f"{root}/model{i % 2}/T{i // 2}/seed_{i}")
    logs = readers.with_run_keys(readers.read_logs(spark, root, _EVENT, "part-*"))
    return logs.groupBy("model", "task", "seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _cut_short(folder: str, name: str, content: bytes) -> None:
    """A damaged file, which no writer of Spark makes."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    files.create_dir(path)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(content)


@query(
    "log_quarantine",
    "SELECT count(*) AS n, round(sum(value), 4) AS total, 3 AS whole_files, 1 AS skipped_files FROM events WHERE event_id % 50 > 1 AND event_id % 4 < 3",
)
def log_quarantine(spark, d):
    """Three packed logs and one that is cut short."""
    root, lines = _folder(spark), _event_lines(spark, d)
    for i in range(3):
        lines.where(F.col("event_id") % 4 == i).select("value").coalesce(1).write.option("compression", "gzip").text(f"{root}/{i}")
    _cut_short(f"{root}/3", "cut.gz", gzip.compress(b'{"event_id": 1, "event_type": "view", "value": 1.0}' * 1000)[:-40])
    rows, files = quarantine.read_whole_logs(spark, root, _EVENT, "*.gz")
    count = lambda status: F.count_if(F.col("status") == status)
    seen = files.agg(count("ok").alias("whole_files"), count("unreadable").alias("skipped_files"))
    return attach(rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), seen, [])


@query("csv_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus")
def csv_table(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double")).write.option("header", True).csv(path)
    o = readers.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))


@query("result_document_file", f"WITH {EPISODES_SQL} SELECT model, task, count(*)::DOUBLE AS n, round(avg(latency_ms), 6) AS avg_latency_ms FROM episodes GROUP BY model, task")
def result_document_file(spark, d):
    """Aggregates written as a nested result document and read from its file."""
    path = _folder(spark)
    per = episodes(spark, d).groupBy("model", "task").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("latency_ms").alias("lat"))
    cell = F.create_map(F.lit("n"), "n", F.lit("avg_latency_ms"), "lat")
    models = per.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("task", cell))).alias("tasks"))
    models.select(F.create_map("model", F.struct("tasks")).alias("models")).write.json(path)
    rows = readers.flatten_results(spark.read.schema(readers.RESULT_SCHEMA).json(path))
    return rounded(rows.select("model", "task", F.col("metrics")["n"].alias("n"), F.col("metrics")["avg_latency_ms"].alias("avg_latency_ms")))


@query(
    "canonical_runs",
    "SELECT o_orderkey, CAST(500 - o_orderkey % 3 * 100 AS INT) AS total_steps, CAST([42, 123, 456, 7][o_custkey % 4 + 1] AS INT) AS seed FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 < 3",
)
def canonical_runs(spark, d):
    seed = F.element_at(F.array(*[F.lit(s) for s in (42, 123, 456, 7)]), (F.col("o_custkey") % 4 + 1).cast("int"))
    runs = table(spark, d, "orders").select("o_orderkey", (500 - F.col("o_orderkey") % 3 * 100).cast("int").alias("total_steps"), seed.alias("seed"))
    return curves.canonical_runs(runs)


@plugins.transform("late_requests")
def _late(df):
    return df.where(F.col("latency_ms") > 3000)


@plugins.scorer("latency_share")
def _share(latency):
    return latency / (latency + 1000.0)


@query(
    "plugin_scores",
    f"WITH {EPISODES_SQL} SELECT model, count(*) AS n, round(avg(latency_ms / (latency_ms + 1000)), 6) AS latency_share FROM episodes WHERE latency_ms > 3000 GROUP BY model",
)
def plugin_scores(spark, d):
    late = episodes(spark, d).transform(plugins.get_transform("late_requests"))
    scored = plugins.apply_scorers(late, {"latency_share": ("latency_ms",)})
    return rounded(scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_share").alias("latency_share")))


_CRITERIA = {"structure": {"json_valid_min": 0.97}, "slo": {"p95_ms_max": 9000.0, "success_at_slo_min": 0.3, "on_time_budget_ms": 2500.0}}


@query(
    "criteria_document",
    f"WITH {EPISODES_SQL}, q AS (SELECT model, quantile_cont(latency_ms, 0.95) AS p95, avg(CAST(latency_ms <= 2500 AS INT)) AS ot, avg(success_at_slo) AS ok, avg(CAST(json_valid AS INT)) AS jv, avg(CAST(schema_valid AS INT)) AS sv, avg(CAST(success_at_slo >= 0.3 AS INT)) AS so FROM episodes GROUP BY model)" + """
  SELECT model, 'json_valid_pass_share' AS metric, round(jv, 6) AS value, NULL::DOUBLE AS "limit", NULL::BOOLEAN AS passed FROM q
  UNION ALL SELECT model, 'schema_valid_pass_share', round(sv, 6), NULL, NULL FROM q
  UNION ALL SELECT model, 'success_at_slo_pass_share', round(so, 6), NULL, NULL FROM q
  UNION ALL SELECT model, 'on_time_rate', round(ot, 6), NULL, NULL FROM q
  UNION ALL SELECT model, 'success_at_slo_rate', round(ok, 6), 0.3, ok >= 0.3 FROM q
  UNION ALL SELECT model, 'p95_ms', round(p95, 6), 9000, p95 <= 9000 FROM q""",
)
def criteria_document(spark, d):
    """Limits from a criteria document that is written to a file and read back; metrics
    that the episodes lack are skipped, aliases are looked up in order."""
    path = _folder(spark)
    spark.createDataFrame([(json.dumps(_CRITERIA),)], "value string").coalesce(1).write.text(path)
    criteria = readers.load_criteria("\n".join(r.value for r in spark.read.text(path).collect()))
    limits = criteria["slo"]
    out = gates.criteria_check(
        episodes(spark, d), ["model"], readers.criteria_thresholds(criteria),
        p95_max=readers.first_present(limits, ["latency_p95_ms_max", "p95_ms_max"]), on_time_ms=readers.first_present(limits, ["on_time_budget_ms"]), success_min=limits["success_at_slo_min"],
    )
    return rounded(out)


_BLOCK = 50


def _parts(spark, rows):
    """One file of lines per part, in order of the event, read back with line numbers."""
    path = _folder(spark)
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    lines = readers.read_numbered_lines(spark, path)
    return lines.withColumn("file", F.regexp_extract("file", "part=(\\w+)/", 1))


@query(
    "manifest_drift",
    f"""WITH e AS (SELECT event_id, event_id % 4 AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line, count(*) OVER (PARTITION BY event_id % 4) AS n FROM events),
  b AS (SELECT part, (line - 1) // {_BLOCK} AS node, min(line) AS first_line, max(line) AS last_line, bool_or(part = 1 AND event_id % 997 = 5) OR bool_or(part = 2 AND line = n) AS changed FROM e GROUP BY ALL)
  SELECT CASE part WHEN 3 THEN 'm3' ELSE 'p' || part END AS file, CASE part WHEN 3 THEN 'missing' ELSE 'changed' END AS status, first_line, last_line FROM b WHERE changed OR part = 3
  UNION ALL SELECT 'n4', 'new', first_line, last_line FROM b WHERE part = 3""",
)
def manifest_drift(spark, d):
    """Four files against a manifest that was kept as a snapshot: one has changed lines, one has
    lost its last line, and one has another name."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("p"), F.to_json(F.struct("event_id", "value")).alias("value"))
    part = F.concat(F.when(F.col("p") == 3, "m").otherwise("p"), F.col("p").cast("string"))
    before = manifest.line_tree(_parts(spark, e.withColumn("part", part)), fanout=_BLOCK)
    print_of = fingerprint.table_fingerprint(before).first()["fingerprint"]
    kept = spark.read.parquet(fingerprint.snapshot(before, _folder(spark), print_of))
    last = e.where("p = 2").agg(F.max("event_id").alias("m"))
    now = e.where(~F.coalesce((F.col("p") == 2) & (F.col("event_id") == last.scalar()), F.lit(False)))
    now = now.withColumn("value", F.when((F.col("p") == 1) & (F.col("event_id") % 997 == 5), F.lit("{}")).otherwise(F.col("value")))
    after = manifest.line_tree(_parts(spark, now.withColumn("part", F.when(F.col("p") == 3, "n4").otherwise(part))), fanout=_BLOCK)
    return manifest.trace_drift(after, kept, fanout=_BLOCK)


@query(
    "ordered_series",
    "WITH o AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders), l AS (SELECT row_number() OVER (ORDER BY price DESC, o_orderkey) AS number, o_orderkey || ' ' || o_custkey || ' ' || price AS value FROM o)"
    " SELECT number + 1 AS number, value FROM l UNION ALL SELECT 1, 'o_orderkey o_custkey price'",
)
def ordered_series(spark, d):
    """Orders by falling price as a series file in parts, read back in order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice").cast("double")).cast("bigint").alias("price"))
    path = _folder(spark)
    sinks.write_ordered_lines(o, path, [F.desc("price"), F.asc("o_orderkey")])
    return sinks.read_ordered_lines(spark, path)


@query(
    "ordered_leaderboard",
    f"""WITH {EPISODES_SQL}, m AS (SELECT model, task, count(*) AS n, CAST(sum(success_at_slo) AS BIGINT) AS success FROM episodes GROUP BY ALL),
  l AS (SELECT row_number() OVER (ORDER BY success / n::DOUBLE DESC, model, task) AS i, * FROM m)
  SELECT i + 2 AS number, '| ' || model || ' | ' || task || ' | ' || n || ' | ' || success || ' |' AS value FROM l
  UNION ALL VALUES (1, '| model | task | n | success |'), (2, '|---|---|---|---|')""",
)
def ordered_leaderboard(spark, d):
    per = episodes(spark, d).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("success_at_slo").cast("bigint").alias("success"))
    path = _folder(spark)
    sinks.write_ordered_lines(per, path, [F.desc(F.col("success") / F.col("n")), F.asc("model"), F.asc("task")], "markdown")
    return sinks.read_ordered_lines(spark, path)
