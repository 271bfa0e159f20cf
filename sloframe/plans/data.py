"""Queries: gates, comparisons, task sets, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sloframe.functions import jsonops
from sloframe.operators import compare, datasets, gates, joins, slo
from sloframe.operators.ordered import attach, exact_quantiles
from sloframe.operators import stability
from sloframe.plans.agreement import REPLICATES_SQL, replicates
from sloframe.plans.registry import ORACLES, query, rounded
from sloframe.plans.views import EPISODES_SQL, episodes, table
from sloframe.session import ensure_checkpoint_dir
from sloframe.sources import fingerprint, readers, sinks

# ---- gates ------------------------------------------------------------------

_RULES = [(None, "json_valid", ">=", 0.99), (None, "schema_valid", ">=", 0.98), ("click", "intent_accuracy", ">=", 0.85), ("view", "faithfulness", ">=", 0.30), ("error", "faithfulness", "<=", 0.90)]


@query(
    "episode_gate",
    f"WITH {EPISODES_SQL}, q AS (SELECT *, json_valid AND schema_valid AND (task <> 'click' OR k % 5 <> 0) AND (task <> 'view' OR (k % 4 <> 0 AND faithfulness >= 0.30::DOUBLE)) AND (task <> 'error' OR faithfulness <= 0.90::DOUBLE) AS quality FROM episodes) "
    "SELECT model, task, count(*) AS n, count(*) FILTER (WHERE quality) AS quality, count(*) FILTER (WHERE latency_ms <= 3000) AS on_time, round(avg(CAST(quality AND latency_ms <= 3000 AS INT)), 6) AS success_at_slo FROM q GROUP BY model, task",
)
def episode_gate(spark, d):
    e = episodes(spark, d)
    as_rate = lambda c: F.col(c).cast("double")
    metrics = {
        "json_valid": as_rate("json_valid"),
        "schema_valid": as_rate("schema_valid"),
        "intent_accuracy": (F.col("k") % 5 != 0).cast("double"),
        "faithfulness": F.when((F.col("task") != "view") | (F.col("k") % 4 != 0), F.col("faithfulness")),
    }
    g = gates.episode_gate(metrics, _RULES, F.col("task"), F.col("latency_ms"), 3000.0)
    out = e.select("model", "task", g.alias("g"))
    return rounded(
        out.groupBy("model", "task").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("g.quality").alias("quality"), F.count_if("g.on_time").alias("on_time"), F.avg("g.success_at_slo").alias("success_at_slo")
        )
    )


_THRESHOLDS = [("structure", "json_valid", ">=", 1.0), ("faithfulness", "faithfulness", ">=", 0.8), ("cost", "tokens_out", "<=", 200.0), ("accuracy", "not_there", ">=", 0.5)]


@query(
    "criteria_check",
    f"WITH {EPISODES_SQL}, a AS (SELECT model, avg(CAST(json_valid AS INT)) AS j, avg(CAST(faithfulness >= 0.8::DOUBLE AS INT)) AS f, avg(CAST(tokens_out <= 200 AS INT)) AS t, avg(CAST(latency_ms <= 3000 AS INT)) AS o,"
    " avg(success_at_slo) AS s, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM episodes GROUP BY model)\n"
    + " UNION ALL ".join(
        f"SELECT model, '{name}' AS metric, round({expr}, 6) AS value, {limit}::DOUBLE AS \"limit\", {passed} AS passed FROM a"
        for name, expr, limit, passed in [
            ("json_valid_pass_share", "j", "NULL", "NULL::BOOLEAN"), ("faithfulness_pass_share", "f", "NULL", "NULL::BOOLEAN"), ("tokens_out_pass_share", "t", "NULL", "NULL::BOOLEAN"),
            ("on_time_rate", "o", "NULL", "NULL::BOOLEAN"), ("success_at_slo_rate", "s", "0.6", "s >= 0.6"), ("p95_ms", "p95", "6000", "p95 <= 6000"), ("p99_ms", "p99", "12000", "p99 <= 12000"),
        ]
    ),
)
def criteria_check(spark, d):
    return rounded(gates.criteria_check(episodes(spark, d), ["model"], _THRESHOLDS, 6000.0, 12000.0, 3000.0, 0.6))


_STAB = "pp AS (SELECT model, prompt_id, max(c) / sum(c) AS agree, sum(c) AS n FROM (SELECT model, prompt_id, canon, count(*) AS c FROM replicates GROUP BY ALL) GROUP BY model, prompt_id), st AS (SELECT model, avg(1 - agree) FILTER (WHERE n >= 5) AS disagreement FROM pp GROUP BY model)"
_SUM = f"WITH {EPISODES_SQL}, {REPLICATES_SQL}, {_STAB}, s AS (SELECT model, avg(CAST(json_valid AS INT)) AS j, avg(CAST(schema_valid AS INT)) AS sv, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, avg(success_at_slo) AS ok, avg(faithfulness) AS faith FROM episodes GROUP BY model)"

# Gates low enough for the driver tables to reach every tier somewhere.
_LOW_GATES = (
    ("bronze", (("json_valid_rate", ">=", 0.98), ("schema_valid_rate", ">=", 0.8), ("p95_latency_ms", "<=", 6200.0))),
    ("silver", (("faithfulness", ">=", 0.53), ("disagreement", "<=", 0.70))),
    ("gold", (("success_at_slo", ">=", 0.6),)),
)


def _gate_summary(spark, d):
    e = episodes(spark, d)
    base = e.groupBy("model").agg(
        slo.rate(F.col("json_valid")).alias("json_valid_rate"), slo.rate(F.col("schema_valid")).alias("schema_valid_rate"),
        F.avg("success_at_slo").alias("success_at_slo"), F.avg("faithfulness").alias("faithfulness"),
    )
    base = attach(base, exact_quantiles(e, ["model"], F.col("latency_ms"), {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}), ["model"])
    dis = stability.disagreement(replicates(spark, d), ["model"], ["prompt_id"], F.col("canon"), 5)
    return attach(base, dis.select("model", F.col("disagreement_at_k").alias("disagreement")), ["model"])


@query(
    "tier_gates",
    f"{_SUM}, b AS (SELECT model, j >= 0.98 AND sv >= 0.8 AND p95 <= 6200 AS bronze, faith >= 0.53 AND disagreement <= 0.70 AS sg, ok >= 0.6 AS gg FROM s JOIN st USING (model))"
    " SELECT model, bronze AS tier_bronze, bronze AND sg AS tier_silver, bronze AND sg AND gg AS tier_gold, CASE WHEN bronze AND sg AND gg THEN 'gold' WHEN bronze AND sg THEN 'silver' WHEN bronze THEN 'bronze' ELSE 'none' END AS highest_tier FROM b",
)
def tier_gates(spark, d):
    out = gates.tier_gates(_gate_summary(spark, d), _LOW_GATES)
    return out.select("model", "tier_bronze", "tier_silver", "tier_gold", "highest_tier")


def _low_certification(tier):
    """Levels of one deadline tier, low enough for the driver tables to reach each somewhere."""
    p95, p99 = gates.CERTIFICATION_LIMITS[tier]
    return (
        ("bronze", (("json_valid_rate", ">=", 0.95), ("schema_valid_rate", ">=", 0.80), ("p95_latency_ms", "<=", p95), ("success_at_slo", ">=", 0.50))),
        ("silver", (("faithfulness", ">=", 0.53), ("disagreement", "<=", 0.70))),
        ("gold", (("success_at_slo", ">=", 0.60), ("p99_latency_ms", "<=", p99))),
    )


@query(
    "certification_tiers",
    f"{_SUM}, l(slo_tier, a, b) AS (VALUES ('interactive', 2000, 3000), ('standard', 5000, 8000), ('batch', 30000, 45000))"
    ", c AS (SELECT model, slo_tier, j >= 0.95 AND sv >= 0.80 AND p95 <= a AND ok >= 0.50 AS bronze, faith >= 0.53 AND disagreement <= 0.70 AS sg, ok >= 0.60 AND p99 <= b AS gg FROM s JOIN st USING (model), l)"
    " SELECT model, slo_tier, bronze AS tier_bronze, bronze AND sg AS tier_silver, bronze AND sg AND gg AS tier_gold,"
    " CASE WHEN bronze AND sg AND gg THEN 'gold' WHEN bronze AND sg THEN 'silver' WHEN bronze THEN 'bronze' ELSE 'none' END AS highest_tier FROM c",
)
def certification_tiers(spark, d):
    return gates.certification(_gate_summary(spark, d), ["model"], _low_certification)


@query(
    "certification_levels",
    f"{_SUM}, l(slo_tier, a) AS (VALUES ('interactive', 2000), ('standard', 5000), ('batch', 30000))"
    ", c AS (SELECT model, slo_tier, j >= 0.95 AND sv >= 0.90 AND p95 <= a AND ok >= 0.70 AS bronze, faith >= 0.80 AND disagreement <= 0.15 AS sg FROM s JOIN st USING (model), l)"
    " SELECT model, slo_tier, bronze AS tier_bronze, bronze AND sg AS tier_silver, false AS tier_gold, CASE WHEN bronze AND sg THEN 'silver' WHEN bronze THEN 'bronze' ELSE 'none' END AS highest_tier FROM c",
)
def certification_levels(spark, d):
    """At the real limits; gold also asks for metrics that these episodes lack."""
    return gates.certification(_gate_summary(spark, d), ["model"])


@query(
    "composite_score",
    f"{_SUM} SELECT model, round(0.3::DOUBLE * j + 0.2::DOUBLE * sv + 0.3::DOUBLE * faith + 0.2::DOUBLE * (1 - disagreement), 6) AS composite_score FROM s JOIN st USING (model)",
)
def composite_score(spark, d):
    weights = {"json_valid_rate": 0.3, "schema_valid_rate": 0.2, "faithfulness": 0.3, "disagreement": 0.2, "tool_success_rate": 0.1}
    return rounded(gates.composite_score(_gate_summary(spark, d), weights, ["disagreement"]).select("model", "composite_score"))


@query(
    "calibration_error",
    f"WITH {EPISODES_SQL}, c AS (SELECT model, least(floor(faithfulness * 10), 9) AS b, count(*) AS n, avg(faithfulness) AS c, avg(CAST(task_correct AS INT)) AS a FROM episodes GROUP BY ALL)"
    " SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS calibration_error FROM c GROUP BY model",
)
def calibration_error(spark, d):
    return rounded(gates.calibration_error(episodes(spark, d), ["model"], "faithfulness", "task_correct"))


_ERFC = "((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x)"


@query(
    "proportion_test",
    f"WITH {EPISODES_SQL}, s AS (SELECT task, count(*) FILTER (WHERE decode_mode = 'd0')::DOUBLE AS n1, count(*) FILTER (WHERE decode_mode = 'd0' AND success_at_slo > 0)::DOUBLE AS s1,"
    " count(*) FILTER (WHERE decode_mode <> 'd0')::DOUBLE AS n0, count(*) FILTER (WHERE decode_mode <> 'd0' AND success_at_slo > 0)::DOUBLE AS s0 FROM episodes GROUP BY task),"
    " z AS (SELECT *, s1 / n1 AS p1, s0 / n0 AS p0, (s1 / n1 - s0 / n0) / sqrt((s1 + s0) / (n1 + n0) * (1 - (s1 + s0) / (n1 + n0)) * (1 / n1 + 1 / n0)) AS z FROM s),"
    " y AS (SELECT *, abs(z) / sqrt(2::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2::DOUBLE)) AS t, 1.959963984540054::DOUBLE AS c FROM z)"
    f" SELECT task, round(p1, 6) AS p1, round(p0, 6) AS p0, round(z, 6) AS z, round({_ERFC}, 6) AS p_value, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p0)), 6) AS cohens_h,"
    " round((p1 + c * c / (2 * n1) - c * sqrt(p1 * (1 - p1) / n1 + c * c / (4 * n1 * n1))) / (1 + c * c / n1), 6) AS p1_lower,"
    " round((p1 + c * c / (2 * n1) + c * sqrt(p1 * (1 - p1) / n1 + c * c / (4 * n1 * n1))) / (1 + c * c / n1), 6) AS p1_upper,"
    f" {_ERFC} < 0.01::DOUBLE / 5 AS significant FROM y",
)
def proportion_test(spark, d):
    return rounded(compare.proportion_test(episodes(spark, d), ["task"], "decode_mode", "d0", F.col("success_at_slo") > 0, 0.01, 5))


@query(
    "ks_distance",
    f"WITH {EPISODES_SQL}, o AS (SELECT task, latency_ms AS v, decode_mode = 'd0' AS a FROM episodes), n AS (SELECT task, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n0 FROM o GROUP BY task),"
    " c AS (SELECT task, v, sum(CAST(a AS INT)) OVER w AS ca, sum(CAST(NOT a AS INT)) OVER w AS cb FROM o WINDOW w AS (PARTITION BY task ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    " SELECT task, n1, n0, round(max(abs(ca / n1 - cb / n0)), 6) AS ks FROM c JOIN n USING (task) GROUP BY task, n1, n0",
)
def ks_distance(spark, d):
    return rounded(compare.ks_distance(episodes(spark, d), ["task"], "latency_ms", "decode_mode", "d0"))


# ---- task sets --------------------------------------------------------------

POOL_SQL = "pool AS (SELECT doc_id, lang, source FROM documents)"


def pool(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source")


@query("sample_n", f"WITH {POOL_SQL} SELECT * FROM pool ORDER BY md5('17|' || doc_id), doc_id LIMIT 100")
def sample_n(spark, d):
    return datasets.sample_n(pool(spark, d), "doc_id", 100, 17)


@query(
    "sample_n_per_group",
    f"WITH {POOL_SQL} SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17|' || doc_id), doc_id) AS r FROM pool) WHERE r <= 5",
)
def sample_n_per_group(spark, d):
    return datasets.sample_n(pool(spark, d), "doc_id", 5, 17, ["source"])


@query("first_n_per_file", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def first_n_per_file(spark, d):
    return datasets.first_n_per_file(pool(spark, d).select("source", "doc_id"), "source", "doc_id", 10)


_TARGET = 270
_POS = f"{POOL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM pool)"
_MIX = f""", g AS (SELECT DISTINCT lang, n FROM p WHERE n < {_TARGET}),
  dr AS (SELECT lang, n + j AS place, ('0x' || substr(md5('7|' || lang || '|' || j), 1, 15))::BIGINT % n AS pos FROM g, range({_TARGET}) t(j) WHERE j < {_TARGET} - n),
  mix AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM p WHERE pos < {_TARGET} UNION ALL SELECT p.doc_id || '_dup' || place, p.lang, p.source FROM dr JOIN p ON p.lang = dr.lang AND p.pos = dr.pos)"""


@query("balanced_mix", f"WITH {_POS}{_MIX} SELECT doc_id, lang, source FROM mix")
def balanced_mix(spark, d):
    return datasets.balanced_mix(pool(spark, d), "lang", "doc_id", _TARGET, "oversample", 7)


@query("undersampled_mix", f"WITH {_POS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM p WHERE pos < 100")
def undersampled_mix(spark, d):
    return datasets.balanced_mix(pool(spark, d), "lang", "doc_id", 100, "undersample", 7)


@query("mix_statistics", f"WITH {_POS}{_MIX} SELECT lang, (SELECT count(*) FROM pool q WHERE q.lang = mix.lang) AS original, count(*) AS balanced FROM mix GROUP BY lang")
def mix_statistics(spark, d):
    before = pool(spark, d)
    return datasets.mix_statistics(before, datasets.balanced_mix(before, "lang", "doc_id", _TARGET, "oversample", 7), "lang")


@query("sample_half", f"WITH {POOL_SQL} SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY md5('29|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM pool) WHERE r <= n // 2")
def sample_half(spark, d):
    p = pool(spark, d).select("doc_id", "lang")
    return datasets.sample_n(p, "doc_id", p.count() // 2, 29)


@query(
    "shuffled_mix",
    f"""WITH {_POS}, t AS (SELECT max(n) AS target FROM p), g AS (SELECT DISTINCT lang, n FROM p),
  dr AS (SELECT lang, n + j AS place, ('0x' || substr(md5('7|' || lang || '|' || j), 1, 15))::BIGINT % n AS pos FROM (SELECT lang, n, unnest(range(target - n)) AS j FROM g, t)),
  mix AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM p UNION ALL SELECT p.doc_id || '_dup' || place, p.lang, p.source FROM dr JOIN p ON p.lang = dr.lang AND p.pos = dr.pos)
  SELECT *, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) - 1 AS place FROM mix""",
)
def shuffled_mix(spark, d):
    """Every language at the size of the largest one, numbered in shuffled order."""
    p = pool(spark, d)
    mix = datasets.balanced_mix(p, "lang", "doc_id", datasets.largest_group(p, "lang"), "oversample", 7)
    return datasets.shuffled(mix, "doc_id", 11)


_TEMPLATES = ["Answer from the context.", "Reply with JSON only.", "Use the text below."]


@query(
    "variant_expand",
    "WITH t(i, s) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_TEMPLATES)) + ") SELECT doc_id || '_v' || i AS id, md5(s || chr(10) || chr(10) || 'Context: ' || text) AS prompt FROM documents, t",
)
def variant_expand(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Old head. Context: "), "text").alias("prompt"))
    return datasets.expand_variants(docs, "id", "prompt", _TEMPLATES).select("id", F.md5("prompt").alias("prompt"))


@query(
    "cyclic_fill",
    "WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark) SELECT CASE WHEN j = 0 THEN CAST(item_id AS VARCHAR) ELSE item_id || '_x' || (p + j * n) END AS item_id"
    " FROM b, range(5000) t(j) WHERE p + j * n < 5000",
)
def cyclic_fill(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    return datasets.cyclic_fill(items, "item_id", [F.floor(F.col("item_id") / 65536)], [F.col("item_id")], 5000)


@query(
    "hash_split",
    "SELECT doc_id, CASE WHEN ('0x' || substr(md5('3|' || doc_id), 1, 8))::BIGINT < 429496729 THEN 'valid' ELSE 'train' END AS split FROM documents",
)
def hash_split(spark, d):
    return datasets.hash_split(pool(spark, d).select("doc_id"), "doc_id", 0.1, 3)


@query(
    "quality_report",
    """WITH e AS (SELECT event_id + 1 AS line, event_id % 50 AS c FROM events) SELECT line, 'invalid JSON' AS problem FROM e WHERE c = 1 UNION ALL SELECT line, 'wrong schema_path' FROM e WHERE c IN (2, 3)
  UNION ALL SELECT line, 'missing gold' FROM e WHERE c IN (3, 4) UNION ALL SELECT line, 'missing prompt' FROM e WHERE c = 4""",
)
def quality_report(spark, d):
    return datasets.quality_report(_task_lines(spark, d), "value", "line", "s.json")


def _task_lines(spark, d):
    c = F.col("event_id") % 50
    good = F.concat(F.lit('{"prompt": "p", "gold": '), "props", F.lit(', "schema_path": "s.json"}'))
    raw = (
        F.when(c == 0, F.lit("  "))
        .when(c == 1, F.concat(good, F.lit("}")))
        .when(c == 2, F.lit('{"prompt": "p", "gold": {}, "schema_path": "t.json"}'))
        .when(c == 3, F.lit('{"prompt": "p"}'))
        .when(c == 4, F.lit('{"schema_path": "s.json"}'))
        .otherwise(good)
    )
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("line"), raw.alias("value"))



@query("quality_report_file", ORACLES["quality_report"])
def quality_report_file(spark, d):
    """The same records, written to files in order and read back with their line numbers."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tasks-{uuid.uuid4().hex}"
    sinks.write_ordered_lines(_task_lines(spark, d), path, ["line"], header=False, columns=["value"])
    return datasets.quality_report(sinks.read_ordered_lines(spark, path), "value", "number", "s.json").withColumnRenamed("number", "line")


_ZIP = "event_id // 3 AS line, event_type AS v FROM events WHERE event_id % 3 = "


@query(
    "positional_join_many",
    f"WITH a AS (SELECT {_ZIP} 0), b AS (SELECT {_ZIP} 1), c AS (SELECT {_ZIP} 2 AND event_id < 700)"
    " SELECT line, a.v || ',' || b.v || ',' || c.v AS outputs, len(list_distinct([a.v, b.v, c.v])) AS n_distinct FROM a JOIN b USING (line) JOIN c USING (line)",
)
def positional_join_many(spark, d):
    """Three logs of one prompt list, the third of which ends early."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("line"), "event_type")
    logs = [e.where(F.col("event_id") % 3 == i).select("line", "event_type") for i in range(2)] + [e.where("event_id % 3 = 2 AND event_id < 700").select("line", "event_type")]
    out = joins.positional_many(logs, [], "line", "event_type")
    return out.select("line", F.array_join("values", ",").alias("outputs"), F.size(F.array_distinct("values")).alias("n_distinct"))


@query(
    "task_records",
    """SELECT 'conv_' || conv_id || '_' || turn AS id, coalesce(CASE WHEN turn % 2 = 0 THEN 'chat' END, 't3') AS task_type, CASE WHEN turn % 3 = 0 THEN 'Request: ' || role ELSE 'P' || turn END AS prompt, 's.json' AS schema_path FROM conversations""",
)
def task_records(spark, d):
    c = table(spark, d, "conversations")
    rec = datasets.task_record(c, F.format_string("conv_%d_%d", "conv_id", "turn"), "chat", F.concat(F.lit("P"), "turn"), "s.json", F.struct("role"))
    part = rec.select(
        "id",
        F.when(F.split("id", "_")[2].cast("int") % 2 == 0, F.col("task_type")).alias("task_type"),
        F.when(F.split("id", "_")[2].cast("int") % 3 != 0, F.col("prompt")).alias("prompt"),
        F.when(F.length("id") % 2 == 0, F.col("schema_path")).alias("schema_path"),
        F.get_json_object("gold", "$.role").alias("question"),
    )
    return datasets.backfill(part, "t3", "s.json", "question").select("id", "task_type", "prompt", "schema_path")


@query(
    "patch_prompts",
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN md5('## Problem' || chr(10) || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Hints' || chr(10) || chr(10) || source ELSE '' END
    || chr(10) || chr(10) || '## Target Tests' || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '- d' || chr(10) || '- ' || lang) END AS prompt FROM documents""",
)
def patch_prompts(spark, d):
    docs = table(spark, d, "documents")
    tests = F.concat(F.lit('["a","b","c","d","'), "lang", F.lit('","f"]'))
    made = datasets.patch_prompt(F.when(F.col("doc_id") % 7 != 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" ")), tests)
    return docs.select("doc_id", F.md5(made).alias("prompt"))


@query("group_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def group_counts(spark, d):
    return pool(spark, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_lookup",
    """SELECT 's' || (event_id % 5) AS schema_path, count(*) AS n, CASE WHEN event_id % 5 < 3 THEN '{"id": ' || (event_id % 5) || '}' END AS schema_json FROM events GROUP BY ALL""",
)
def schema_lookup(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id") % 5).alias("schema_path"))
    return readers.attach_schema(e, _schemas(spark), "schema_path").groupBy("schema_path", "schema_json").agg(F.count(F.lit(1)).alias("n"))


def _schemas(spark):
    return spark.createDataFrame([(f"s{i}", f'{{"id": {i}}}') for i in range(3)], "schema_path string, schema_json string")


@query("missing_schemas", "SELECT 's' || (event_id % 5) AS schema_path, count(*) AS n FROM events WHERE event_id % 5 >= 3 GROUP BY 1")
def missing_schemas(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id") % 5).alias("schema_path"))
    return readers.missing_schemas(e, _schemas(spark))


def _fp_sql(columns: list[str], tab: str) -> str:
    text = " || ".join(f"coalesce('=' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    part = lambda at: f"CAST(sum(('0x' || substr(md5({text}), {at}, 12))::BIGINT) AS VARCHAR)"
    return f"SELECT source, count(*) AS n_rows, count(*) || '-' || {part(1)} || '-' || {part(17)} AS fp FROM {tab} GROUP BY source"


@query(
    "table_fingerprint",
    _fp_sql(["doc_id", "text", "lang"], "documents").replace(" AS fp", " AS fingerprint"),
)
def table_fingerprint(spark, d):
    return fingerprint.table_fingerprint(table(spark, d, "documents"), ["source"], ["doc_id", "text", "lang"])


@query(
    "fingerprint_drift",
    f"""WITH now AS (SELECT * FROM documents WHERE source <> 'src1'), old AS (SELECT doc_id, text, CASE WHEN source = 'src2' AND doc_id % 2 = 0 THEN NULL ELSE lang END AS lang, source FROM documents WHERE source <> 'src3'),
  a AS ({_fp_sql(['doc_id', 'text', 'lang'], 'now')}), e AS ({_fp_sql(['doc_id', 'text', 'lang'], 'old')})
  SELECT source, a.fp AS actual, e.fp AS expected, CASE WHEN e.fp IS NULL THEN 'new' WHEN a.fp IS NULL THEN 'missing' WHEN a.fp = e.fp THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN e USING (source)""",
)
def fingerprint_drift(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    old = docs.where("source <> 'src3'").withColumn("lang", F.when(~((F.col("source") == "src2") & (F.col("doc_id") % 2 == 0)), F.col("lang")))
    cols = ["doc_id", "text", "lang"]
    return fingerprint.drift(
        fingerprint.table_fingerprint(docs.where("source <> 'src1'"), ["source"], cols), fingerprint.table_fingerprint(old, ["source"], cols), ["source"]
    )


@query(
    "log_level_filter",
    "SELECT event_type, count(*) AS n FROM events WHERE event_id % 6 <> 0 GROUP BY 1",
)
def log_level_filter(spark, d):
    from sloframe.operators.filters import at_least_level

    e = table(spark, d, "events")
    level = F.element_at(F.array(*[F.lit(x) for x in ("debug", "INFO", "Warning", "ERROR", "NOTICE", None)]), (F.col("event_id") % 6 + 1).cast("int"))
    return at_least_level(e.withColumn("level", level), "level", "INFO").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("failed_runs", "SELECT o_orderkey, 'm' || (o_custkey % 11) AS model, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')")
def failed_runs(spark, d):
    from sloframe.operators.filters import failed

    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey") % 11).alias("model"), F.col("o_orderstatus").alias("status"))
    return failed(o, "status", ["F", "P"])


@query(
    "run_key_parts",
    "SELECT c_custkey, 'model_' || (c_custkey % 7) AS model, 'T' || (c_custkey % 5) AS task, CAST(c_custkey AS INT) AS seed FROM customer",
)
def run_key_parts(spark, d):
    key = F.format_string("model_%d_T%d_seed%d", F.col("c_custkey") % 7, F.col("c_custkey") % 5, F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", readers.split_run_key(key).alias("k")).select("c_custkey", "k.*")


@query(
    "result_document_rows",
    f"WITH {EPISODES_SQL} SELECT model, task, count(*)::DOUBLE AS n, round(avg(latency_ms), 6) AS avg_latency_ms FROM episodes GROUP BY model, task",
)
def result_document_rows(spark, d):
    """Aggregates packed into the nested document form per model and unpacked again."""
    e = episodes(spark, d)
    per = e.groupBy("model", "task").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("latency_ms").alias("lat"))
    packed = per.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("task", F.create_map(F.lit("n"), F.col("n"), F.lit("avg_latency_ms"), F.col("lat"))))).alias("tasks")
    )
    doc = packed.select(F.create_map(F.col("model"), F.struct("tasks")).alias("models"))
    rows = readers.flatten_results(doc)
    return rounded(rows.select("model", "task", F.col("metrics")["n"].alias("n"), F.col("metrics")["avg_latency_ms"].alias("avg_latency_ms")))


@query(
    "report_lines",
    f"WITH {EPISODES_SQL} SELECT '| ' || model || ' | ' || count(*) || ' | ' || printf('%.1f', avg(k)) || ' |' AS line FROM episodes GROUP BY model",
)
def report_lines(spark, d):
    from sloframe.sources.sinks import markdown_lines

    e = episodes(spark, d)
    return markdown_lines(e.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("avg_k")), {"avg_k": "%.1f"})


@query(
    "top_errors",
    "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5",
)
def top_errors(spark, d):
    from sloframe.operators.ordered import first_rows

    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return first_rows(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 5).drop("__rn")


@query(
    "context_precision_recall",
    """WITH x AS (SELECT doc_id, lang, list_distinct([doc_id % 3, doc_id % 5, 7]) AS p, list_distinct([doc_id % 5, doc_id % 7]) AS g FROM documents)
  SELECT lang, round(avg(len(list_intersect(p, g)) / len(p)), 6) AS context_precision, round(avg(len(list_intersect(p, g)) / len(g)), 6) AS context_recall FROM x GROUP BY lang""",
)
def context_precision_recall(spark, d):
    from sloframe.functions.text import set_precision_recall

    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("lang", set_precision_recall(F.array(i % 3, i % 5, F.lit(7).cast("bigint")), F.array(i % 5, i % 7)).alias("s"))
    return rounded(docs.groupBy("lang").agg(F.avg("s.precision").alias("context_precision"), F.avg("s.recall").alias("context_recall")))
