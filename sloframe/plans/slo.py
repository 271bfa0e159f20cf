"""Queries: deadline tiers, latency summaries, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sloframe.operators import ranking, resample, slo
from sloframe.operators.ordered import exact_quantiles
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import EPISODES_SQL, TIERS_SQL, episodes, wide, table

TASKS = ["click", "error", "purchase", "signup", "view"]

_COUNTS = """counts AS (
  SELECT model, task, tier, deadline_ms, count(*) AS total,
    count(*) FILTER (WHERE task_correct) AS correct,
    count(*) FILTER (WHERE latency_ms <= deadline_ms) AS on_time,
    count(*) FILTER (WHERE latency_ms <= deadline_ms AND task_correct AND json_valid) AS success_at_slo
  FROM episodes, tiers GROUP BY ALL)"""
_BOARD = """per_model AS (
  SELECT model, tier, sum(total) AS total, 100.0::DOUBLE * sum(correct) / greatest(1, sum(total)) AS accuracy_pct,
    100.0::DOUBLE * sum(success_at_slo) / greatest(1, sum(total)) AS success_pct
  FROM counts GROUP BY model, tier),
board AS (
  SELECT *, rank() OVER (PARTITION BY tier ORDER BY accuracy_pct DESC) + (count(*) OVER (PARTITION BY tier, accuracy_pct) - 1) / 2.0::DOUBLE AS accuracy_rank,
    rank() OVER (PARTITION BY tier ORDER BY success_pct DESC) + (count(*) OVER (PARTITION BY tier, success_pct) - 1) / 2.0::DOUBLE AS slo_rank,
    row_number() OVER (PARTITION BY tier ORDER BY accuracy_pct DESC, model) AS accuracy_place,
    row_number() OVER (PARTITION BY tier ORDER BY success_pct DESC, model) AS slo_place
  FROM per_model)"""
_HEAD = f"WITH {EPISODES_SQL}, {TIERS_SQL}, {_COUNTS}, {_BOARD} "


def _board(spark, d):
    counts = slo.tier_counts(episodes(spark, d), ["model", "task"])
    return ranking.leaderboard(slo.weighted_accuracy(counts, ["model", "tier"]))


@query(
    "slo_leaderboard",
    _HEAD + """SELECT model, tier, CAST(total AS BIGINT) AS total, round(accuracy_pct, 6) AS accuracy_pct, round(success_pct, 6) AS success_pct,
    accuracy_rank, slo_rank, CAST(accuracy_place AS INT) AS accuracy_place, CAST(slo_place AS INT) AS slo_place, accuracy_rank - slo_rank AS rank_delta FROM board""",
)
def slo_leaderboard(spark, d):
    return rounded(_board(spark, d))


@query(
    "slo_by_task_tier",
    f"WITH {EPISODES_SQL}, {TIERS_SQL}" + """ SELECT model, coalesce(task, 'ALL') AS task, tier, deadline_ms, count(*) AS total,
    count(*) FILTER (WHERE task_correct) AS correct, count(*) FILTER (WHERE latency_ms <= deadline_ms) AS on_time,
    count(*) FILTER (WHERE latency_ms <= deadline_ms AND task_correct AND json_valid) AS success_at_slo,
    round(100.0::DOUBLE * count(*) FILTER (WHERE task_correct) / count(*), 6) AS accuracy_pct,
    round(100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= deadline_ms) / count(*), 6) AS on_time_pct,
    round(100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= deadline_ms AND task_correct AND json_valid) / count(*), 6) AS success_pct
  FROM episodes, tiers GROUP BY GROUPING SETS ((model, task, tier, deadline_ms), (model, tier, deadline_ms))""",
)
def slo_by_task_tier(spark, d):
    return rounded(slo.with_percentages(slo.tier_counts_with_total(episodes(spark, d), "model", "task")))


@query(
    "slo_scorer_means",
    f"WITH {EPISODES_SQL}" + """ SELECT task, round(avg(CAST(latency_ms <= 2000 AS INT)), 6) AS on_time, round(avg(CAST(task_correct AS INT)), 6) AS correct,
    round(avg(CAST(json_valid AS INT)), 6) AS json_valid,
    round(avg(CAST(latency_ms <= 2000 AND task_correct AND json_valid AS INT)), 6) AS success_at_slo FROM episodes GROUP BY task""",
)
def slo_scorer_means(spark, d):
    flags = slo.tier_flags(F.col("latency_ms"), F.col("task_correct"), F.col("json_valid"), 2000.0)
    e = episodes(spark, d).select("task", flags.alias("f"))
    return rounded(e.groupBy("task").agg(*[F.avg(f"f.{c}").alias(c) for c in ("on_time", "correct", "json_valid", "success_at_slo")]))


CURVE = [250.0 * i for i in range(1, 41)]


@query(
    "slo_curve",
    f"WITH {EPISODES_SQL}, cuts AS (SELECT 250.0::DOUBLE * i AS threshold_ms FROM range(1, 41) t(i))" + """
  SELECT decode_mode, threshold_ms, count(*) AS n, count(*) FILTER (WHERE latency_ms <= threshold_ms) AS on_time,
    count(*) FILTER (WHERE latency_ms <= threshold_ms AND task_correct AND json_valid) AS success,
    round(count(*) FILTER (WHERE latency_ms <= threshold_ms) / count(*), 6) AS on_time_share,
    round(count(*) FILTER (WHERE latency_ms <= threshold_ms AND task_correct AND json_valid) / count(*), 6) AS success_share
  FROM episodes, cuts GROUP BY decode_mode, threshold_ms""",
)
def slo_curve(spark, d):
    ok = F.col("task_correct") & F.col("json_valid")
    return rounded(slo.success_curve(episodes(spark, d), ["decode_mode"], CURVE, success=ok))


@query(
    "slo_curve_table",
    f"WITH {EPISODES_SQL}, cuts AS (SELECT DISTINCT p_size * 100.0::DOUBLE AS threshold_ms FROM part), l AS (SELECT task, CASE WHEN event_id % 89 <> 0 THEN latency_ms END AS latency_ms FROM episodes)" + """
  SELECT task, threshold_ms, count(*) AS n, count(*) FILTER (WHERE latency_ms <= threshold_ms) AS on_time,
    round(count(*) FILTER (WHERE latency_ms <= threshold_ms) / count(*), 6) AS on_time_share
  FROM l, cuts GROUP BY task, threshold_ms""",
)
def slo_curve_table(spark, d):
    cuts = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") * 100.0).alias("threshold_ms")).distinct()
    e = episodes(spark, d).withColumn("latency_ms", F.when(F.col("event_id") % 89 != 0, F.col("latency_ms")))
    return rounded(slo.success_curve_table(e, ["task"], cuts))


_SUMMARY = """count(*) AS num_episodes, round(avg(CAST(json_valid AS INT)), 6) AS json_valid_rate, round(avg(CAST(schema_valid AS INT)), 6) AS schema_valid_rate,
  round(avg(success_at_slo), 6) AS success_at_slo, round(avg(retry_count), 6) AS avg_retry_count, round(avg(repair_count), 6) AS avg_repair_count,
  round(avg(candidate_count), 6) AS avg_candidate_count, round(avg(CAST(retry_count > 0 AS INT)), 6) AS retry_rate,
  round(avg(CAST(repair_count > 0 AS INT)), 6) AS repair_rate, round(avg(CAST(candidate_count > 1 AS INT)), 6) AS candidate_rate,
  round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms,
  round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms"""


@query("suite_summary", f"WITH {EPISODES_SQL} SELECT model, {_SUMMARY} FROM episodes GROUP BY model")
def suite_summary(spark, d):
    return rounded(slo.suite_summary(episodes(spark, d), ["model"]))


@query("suite_summary_overall", f"WITH {EPISODES_SQL} SELECT {_SUMMARY} FROM episodes")
def suite_summary_overall(spark, d):
    return rounded(slo.suite_summary(episodes(spark, d), []))


@query(
    "metric_means_long",
    f"WITH {EPISODES_SQL}, long AS (" + """
  SELECT task, 'json_valid' AS metric, CAST(json_valid AS INT)::DOUBLE AS v FROM episodes
  UNION ALL SELECT task, 'faithfulness', faithfulness FROM episodes WHERE k % 2 = 0
  UNION ALL SELECT task, 'success_at_slo', success_at_slo FROM episodes
  UNION ALL SELECT task, 'ttft_ms', ttft_ms FROM episodes)
  SELECT task, metric, round(avg(v), 6) AS mean, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY task, metric""",
)
def metric_means_long(spark, d):
    e = episodes(spark, d).withColumn(
        "metrics",
        F.create_map(
            F.lit("json_valid"), F.col("json_valid").cast("double"),
            F.lit("faithfulness"), F.when(F.col("k") % 2 == 0, F.col("faithfulness")),
            F.lit("success_at_slo"), F.col("success_at_slo"),
            F.lit("ttft_ms"), F.col("ttft_ms"),
        ),
    )
    return rounded(slo.metric_means(e, ["task"]))


@query(
    "log_summary_by_source",
    """WITH logs AS (SELECT 'src' || (event_id % 20) AS source, value * 100 AS latency_ms, CAST(event_id % 97 <> 0 AS INT) AS json_valid,
    CASE WHEN event_id % 11 <> 0 THEN value * 10 END AS ttft_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS tokens_out,
    event_id % 29 = 0 AS bad FROM events)
  SELECT source, count(*) AS n, round(100 * avg(json_valid), 6) AS json_valid_pct, round(avg(ttft_ms), 6) AS mean_ttft_ms,
    round(avg(tokens_out), 6) AS mean_tokens_out,
    round(quantile_cont(latency_ms, 0.95) FILTER (WHERE NOT bad), 6) AS p95_latency_ms,
    round(quantile_cont(latency_ms, 0.99) FILTER (WHERE NOT bad), 6) AS p99_latency_ms FROM logs GROUP BY source""",
)
def log_summary_by_source(spark, d):
    e = episodes(spark, d)
    logs = e.select(
        F.concat(F.lit("src"), F.col("event_id") % 20).alias("source"),
        F.when(F.col("event_id") % 29 == 0, F.lit("n/a")).otherwise(F.col("latency_ms").cast("string")).alias("latency_ms"),
        F.col("json_valid").cast("int").alias("json_valid"),
        "ttft_ms",
        "tokens_out",
    )
    return rounded(slo.log_summary(logs, "source"))


@query(
    "latency_percentiles_linear",
    f"WITH {EPISODES_SQL}" + """ SELECT model, task, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
    round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM episodes GROUP BY model, task""",
)
def latency_percentiles_linear(spark, d):
    return rounded(exact_quantiles(episodes(spark, d), ["model", "task"], F.col("latency_ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


_INDEX_RULES = {
    "index_n": "CAST(floor({p} * n) AS BIGINT)",
    "index_n_minus_1": "CAST(floor({p} * (n - 1)) AS BIGINT)",
    "index_n_or_max_below_20": "CASE WHEN n >= 20 THEN CAST(floor({p} * n) AS BIGINT) ELSE n - 1 END",
    "index_n_clamped": "least(CAST(floor({p} * n) AS BIGINT), n - 1)",
}


@query(
    "latency_percentiles_index",
    f"WITH {EPISODES_SQL}, o AS (SELECT user_id, latency_ms, row_number() OVER (PARTITION BY user_id ORDER BY latency_ms) - 1 AS i, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM episodes)\n"
    + "\nUNION ALL ".join(
        f"SELECT user_id, '{rule}' AS rule, round(max(latency_ms) FILTER (WHERE i = {r.format(p='0.95::DOUBLE')}), 6) AS p95, "
        f"round(max(latency_ms) FILTER (WHERE i = {r.format(p='0.99::DOUBLE')}), 6) AS p99 FROM o GROUP BY user_id"
        for rule, r in _INDEX_RULES.items()
    ),
)
def latency_percentiles_index(spark, d):
    e = episodes(spark, d)
    out = None
    for rule in _INDEX_RULES:
        q = exact_quantiles(e, ["user_id"], F.col("latency_ms"), {"p95": 0.95, "p99": 0.99}, rule).withColumn("rule", F.lit(rule))
        out = q if out is None else out.unionByName(q)
    return rounded(out.select("user_id", "rule", "p95", "p99"))


@query(
    "sentinel_filtered_latency",
    """WITH e AS (SELECT 'm' || (user_id % 13) AS model, CASE WHEN event_id % 53 = 0 THEN 1e6::DOUBLE ELSE value * 100 END AS latency_ms,
    event_id % 97 <> 0 AS json_valid, CAST(json_extract_string(props, '$.k') AS BIGINT) >= 30 AS task_correct FROM events),
  o AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model) AS m FROM e WHERE latency_ms < 1e5),
  q AS (SELECT model, max(latency_ms) FILTER (WHERE i = least(CAST(floor(0.95::DOUBLE * m) AS BIGINT), m - 1)) AS p95,
    max(latency_ms) FILTER (WHERE i = least(CAST(floor(0.99::DOUBLE * m) AS BIGINT), m - 1)) AS p99 FROM o GROUP BY model),
  b AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE latency_ms < 1e5) AS n_kept, round(avg(latency_ms) FILTER (WHERE latency_ms < 1e5), 6) AS avg_latency_ms,
    round(100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= 2000) / count(*), 6) AS on_time_pct,
    round(100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= 2000 AND json_valid AND task_correct) / count(*), 6) AS success_pct FROM e GROUP BY model)
  SELECT b.*, round(p95, 6) AS p95_latency_ms, round(p99, 6) AS p99_latency_ms FROM b JOIN q USING (model)""",
)
def sentinel_filtered_latency(spark, d):
    e = episodes(spark, d).withColumn("latency_ms", F.when(F.col("event_id") % 53 == 0, F.lit(1e6)).otherwise(F.col("latency_ms")))
    return rounded(slo.without_sentinels(e, ["model"]))


@query(
    "latency_histogram",
    f"WITH {EPISODES_SQL}, s AS (SELECT decode_mode, min(latency_ms) AS lo, max(latency_ms) AS hi FROM episodes GROUP BY decode_mode)" + """
  SELECT decode_mode, CAST(least(floor((latency_ms - lo) / (hi - lo) * 30), 29) AS INT) AS bin,
    round(lo + (hi - lo) * CAST(least(floor((latency_ms - lo) / (hi - lo) * 30), 29) AS INT) / 30, 6) AS bin_start, count(*) AS n
  FROM episodes JOIN s USING (decode_mode) GROUP BY ALL""",
)
def latency_histogram(spark, d):
    return rounded(slo.latency_histogram(episodes(spark, d), ["decode_mode"], "latency_ms"))


@query(
    "tradeoff_by_mode",
    f"WITH {EPISODES_SQL}" + """ SELECT decode_mode, count(*) AS n, round(avg(success_at_slo), 6) AS success_at_slo, round(avg(faithfulness), 6) AS faithfulness,
    round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM episodes GROUP BY decode_mode""",
)
def tradeoff_by_mode(spark, d):
    return rounded(slo.tradeoff_by_mode(episodes(spark, d)))


_EXTRA = """est AS (SELECT *, greatest(0, least(100, CASE WHEN p95 <= 5000 THEN 95 + 4 * greatest(0, 1 - p99 / 5000)
      WHEN al <= 5000 THEN 100 * least(1, 5000 / greatest(1, p95)) * 0.95::DOUBLE
      ELSE greatest(0, 100 * (1 - (al - 5000) / greatest(1, p99 - 5000))) * 0.5::DOUBLE END)) AS s5,
    greatest(0, least(100, CASE WHEN p99 <= 30000 THEN 99.5::DOUBLE WHEN p95 <= 30000 THEN 95 + 4.5::DOUBLE * greatest(0, 1 - p99 / 30000)
      ELSE 100 * least(1, 30000 / greatest(1, p99)) * 0.95::DOUBLE END)) AS s30
  FROM (SELECT model, task, count(*) AS n, avg(CAST(task_correct AS INT)) AS acc, avg(latency_ms) AS al, quantile_cont(latency_ms, 0.95) AS p95,
    quantile_cont(latency_ms, 0.99) AS p99, 100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= 2000) / count(*) AS ot,
    100.0::DOUBLE * count(*) FILTER (WHERE latency_ms <= 2000 AND task_correct AND json_valid) / count(*) AS ss FROM episodes GROUP BY model, task))"""


def _extra_row(tier: str, on: str, ok: str) -> str:
    whole = lambda x: f"CAST(trunc({x}) AS BIGINT)"
    return (
        f"SELECT model, task, '{tier}' AS tier, n AS total, {whole(f'n * {on} / 100')} AS on_time, {whole('n * acc')} AS correct, "
        f"{whole(f'n * {ok} / 100')} AS success_at_slo FROM est"
    )


@query(
    "tier_extrapolation",
    f"WITH {EPISODES_SQL}, {_EXTRA} "
    + " UNION ALL ".join([_extra_row("interactive", "ot", "ss"), _extra_row("standard", "s5", "(s5 * acc)"), _extra_row("batch", "s30", "(s30 * acc)")]),
)
def tier_extrapolation(spark, d):
    e = episodes(spark, d)
    keys = ["model", "task"]
    on = F.col("latency_ms") <= 2000
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        slo.rate(F.col("task_correct")).alias("accuracy"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        (100.0 * F.count_if(on) / F.count(F.lit(1))).alias("latency_slo_pct"),
        (100.0 * F.count_if(on & F.col("task_correct") & F.col("json_valid")) / F.count(F.lit(1))).alias("success_at_slo_pct"),
    )
    cuts = {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return slo.extrapolate_tiers(slo.attach(base, exact_quantiles(e, keys, F.col("latency_ms"), cuts), keys))


@query(
    "completion_matrix",
    "WITH e AS (SELECT 'm' || (user_id % 13) AS model, event_type AS task FROM events WHERE NOT (user_id % 13 IN (3, 7) AND event_type = 'signup')), m AS (SELECT DISTINCT 'm' || (c_custkey % 15) AS model FROM customer) SELECT model, "
    + ", ".join(f"count(*) FILTER (WHERE task = '{t}') AS {t}" for t in TASKS)
    + ", CAST(count(DISTINCT task) AS INT) AS tasks_done, round(100.0::DOUBLE * count(DISTINCT task) / 5, 6) AS complete_pct FROM m LEFT JOIN e USING (model) GROUP BY model",
)
def completion_matrix(spark, d):
    return rounded(slo.completion_matrix(_incomplete(spark, d), "model", "task", TASKS, _expected_models(spark, d)))


def _expected_models(spark, d):
    """Two more models than ever ran."""
    return table(spark, d, "customer").select(F.concat(F.lit("m"), F.col("c_custkey") % 15).alias("model"))


def _incomplete(spark, d):
    e = episodes(spark, d)
    return e.where(~(F.col("model").isin("m3", "m7") & (F.col("task") == "signup")))


@query(
    "completion_gaps",
    """WITH e AS (SELECT DISTINCT 'm' || (user_id % 13) AS model, event_type AS task FROM events WHERE NOT (user_id % 13 IN (3, 7) AND event_type = 'signup'))
  SELECT m.model, t.task FROM (SELECT DISTINCT 'm' || (c_custkey % 15) AS model FROM customer) m, (SELECT DISTINCT task FROM e) t ANTI JOIN e ON e.model = m.model AND e.task = t.task""",
)
def completion_gaps(spark, d):
    return slo.completion_gaps(slo.completion_matrix(_incomplete(spark, d), "model", "task", TASKS, _expected_models(spark, d)), "model", TASKS)


@query(
    "load_summary",
    f"WITH {EPISODES_SQL}, r AS (SELECT model AS run, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + latency_ms / 1000 AS f, task_correct AND json_valid AS ok, ttft_ms, latency_ms FROM episodes)," + """
  o AS (SELECT run, latency_ms, row_number() OVER (PARTITION BY run ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY run) AS m FROM r),
  q AS (SELECT run, max(latency_ms) FILTER (WHERE i = least(CAST(floor(0.95::DOUBLE * m) AS BIGINT), m - 1)) AS p95,
    max(latency_ms) FILTER (WHERE i = least(CAST(floor(0.99::DOUBLE * m) AS BIGINT), m - 1)) AS p99 FROM o GROUP BY run)
  SELECT run, n, round(el, 3) AS elapsed_s, success_pct, mean_ttft_ms, round(n / el, 6) AS effective_rps, round(p95, 6) AS p95_latency_ms, round(p99, 6) AS p99_latency_ms
  FROM (SELECT run, count(*) AS n, max(f) - min(s) AS el, round(100 * avg(CAST(ok AS INT)), 6) AS success_pct, round(avg(ttft_ms), 6) AS mean_ttft_ms FROM r GROUP BY run) JOIN q USING (run)""",
)
def load_summary(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = episodes(spark, d).select(
        F.col("model").alias("run"),
        start.alias("s"),
        (start + F.col("latency_ms") / 1000).alias("f"),
        (F.col("task_correct") & F.col("json_valid")).alias("success"),
        "ttft_ms",
        "latency_ms",
    )
    out = rounded(slo.load_summary(e, "run", "s", "f"))
    return out.withColumn("elapsed_s", F.round("elapsed_s", 3))


# ---- ranks -----------------------------------------------------------------


@query("avg_rank", _HEAD + "SELECT tier, model, accuracy_rank, slo_rank FROM board")
def avg_rank(spark, d):
    return _board(spark, d).select("tier", "model", "accuracy_rank", "slo_rank")


@query("ordinal_rank", _HEAD + "SELECT tier, model, CAST(accuracy_place AS INT) AS accuracy_place, CAST(slo_place AS INT) AS slo_place FROM board")
def ordinal_rank(spark, d):
    return _board(spark, d).select("tier", "model", "accuracy_place", "slo_place")


@query(
    "rank_inversions",
    _HEAD + """SELECT tier, count(*) AS n_models, count(*) FILTER (WHERE abs(accuracy_rank - slo_rank) > 2) AS rank_inversions,
    max(abs(accuracy_rank - slo_rank)) AS max_delta FROM board GROUP BY tier""",
)
def rank_inversions(spark, d):
    return ranking.inversions(_board(spark, d))


_ERFC = """((((({a5} * t + {a4}) * t + {a3}) * t + {a2}) * t + {a1}) * t * exp(-x * x))""".format(
    a1="0.254829592::DOUBLE", a2="(-0.284496736::DOUBLE)", a3="1.421413741::DOUBLE", a4="(-1.453152027::DOUBLE)", a5="1.061405429::DOUBLE"
)


def _p_sql(z: str) -> str:
    """SQL for the two-sided p-value of |z|."""
    return f"(SELECT {_ERFC} FROM (SELECT x, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (SELECT abs({z}) / sqrt(2::DOUBLE) AS x)))"


@query(
    "spearman",
    _HEAD + f""", s AS (SELECT tier, count(*) AS n, coalesce(corr(accuracy_rank, slo_rank), 0) AS rho,
    1 - 6 * sum((accuracy_rank - slo_rank) ** 2) / (count(*) * (count(*) * count(*) - 1)) AS rho_d2 FROM board GROUP BY tier),
  z AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS z1,
    rho_d2 * sqrt((n - 2) / (1 - rho_d2 * rho_d2)) * sqrt(1 - 1 / (4.0::DOUBLE * (n - 2)) - 7 / (120.0::DOUBLE * (n - 2) * (n - 2))) AS z2 FROM s)
  SELECT tier, n, round(rho, 6) AS rho, round(rho_d2, 6) AS rho_d2, round({_p_sql('z1')}, 6) AS p_value, round({_p_sql('z2')}, 6) AS p_value_small_sample FROM z""",
)
def spearman(spark, d):
    return rounded(ranking.spearman(_board(spark, d), ["tier"], "accuracy_pct", "success_pct"))


_B = 200


@query(
    "bootstrap_spearman",
    _HEAD + f""", placed AS (SELECT tier, accuracy_pct AS a, success_pct AS b, row_number() OVER (PARTITION BY tier ORDER BY model) - 1 AS j, count(*) OVER (PARTITION BY tier) AS n FROM per_model),
  picks AS (SELECT p.tier, r, p.j AS slot, ('0x' || substr(md5('42|' || r || '|' || p.j), 1, 8))::BIGINT % p.n AS pick FROM placed p, range({_B}) t(r)),
  drawn AS (SELECT k.tier, k.r, v.a, v.b FROM picks k JOIN placed v ON v.tier = k.tier AND v.j = k.pick),
  ranked AS (SELECT tier, r, rank() OVER (PARTITION BY tier, r ORDER BY a DESC) + (count(*) OVER (PARTITION BY tier, r, a) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY tier, r ORDER BY b DESC) + (count(*) OVER (PARTITION BY tier, r, b) - 1) / 2.0::DOUBLE AS rb FROM drawn),
  sums AS (SELECT tier, r, count(*)::DOUBLE AS n, sum(ra) AS sa, sum(rb) AS sb, sum(ra * ra) AS saa, sum(rb * rb) AS sbb, sum(ra * rb) AS sab FROM ranked GROUP BY tier, r),
  rhos AS (SELECT tier, r, CASE WHEN n >= 3 AND n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) ELSE 0 END AS rho FROM sums),
  ord AS (SELECT tier, rho, row_number() OVER (PARTITION BY tier ORDER BY rho) - 1 AS i FROM rhos),
  ci AS (SELECT tier, max(rho) FILTER (WHERE i = {int(.025 * _B)}) AS lo, max(rho) FILTER (WHERE i = {int(.975 * _B)}) AS hi FROM ord GROUP BY tier),
  s AS (SELECT tier, count(*) AS n, coalesce(corr(accuracy_rank, slo_rank), 0) AS rho FROM board GROUP BY tier),
  z AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS z1 FROM s)
  SELECT tier, n, round(rho, 6) AS rho, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round({_p_sql('z1')}, 6) AS p_value FROM z JOIN ci USING (tier)""",
)
def bootstrap_spearman(spark, d):
    rows = slo.weighted_accuracy(slo.tier_counts(episodes(spark, d), ["model", "task"]), ["model", "tier"])
    return rounded(ranking.bootstrap_spearman(rows, ["tier"], "model", "accuracy_pct", "success_pct", resamples=_B))


@query(
    "bootstrap_mean_ci",
    """WITH base AS (SELECT event_type AS task, event_id, value AS v FROM events),
  h AS (SELECT task, v, g, md5('17|' || event_id || '|' || g) AS m FROM base, range(8) t(g)),
  w AS (SELECT task, g * 8 + i AS r, v, ('0x' || substr(m, CAST(1 + 4 * i AS INT), 4))::BIGINT AS bits FROM h, range(8) u(i)),
  x AS (SELECT task, r, v, """
    + " + ".join(f"CAST(bits >= {c} AS INT)" for c in ranking.POISSON_CUTS)
    + """ AS wt FROM w),
  m AS (SELECT task, r, sum(wt * v) / sum(wt) AS mean FROM x GROUP BY task, r HAVING sum(wt) > 0),
  o AS (SELECT task, mean, row_number() OVER (PARTITION BY task ORDER BY mean) - 1 AS i, count(*) OVER (PARTITION BY task) AS c FROM m)
  SELECT task, b.n, round(b.mean, 6) AS mean, round(max(o.mean) FILTER (WHERE i = floor(0.025::DOUBLE * (c - 1))), 6) AS ci_lower,
    round(max(o.mean) FILTER (WHERE i = floor(0.975::DOUBLE * (c - 1))), 6) AS ci_upper
  FROM o JOIN (SELECT task, count(*) AS n, avg(v) AS mean FROM base GROUP BY task) b USING (task) GROUP BY task, b.n, b.mean""",
)
def bootstrap_mean_ci(spark, d):
    e = wide(spark, d, "events", "event_type", "event_id", "value").withColumnRenamed("event_type", "task")
    return rounded(ranking.bootstrap_mean(e, ["task"], F.col("event_id"), "value", resamples=64))


_PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "latency_percentile_ci",
    """WITH base AS (SELECT event_type AS task, event_id, value * 100 AS v FROM events),
  h AS (SELECT task, v, g, md5('17|' || event_id || '|' || g) AS m FROM base, range(8) t(g)),
  w AS (SELECT task, g * 8 + i AS r, v, ('0x' || substr(m, CAST(1 + 4 * i AS INT), 4))::BIGINT AS bits FROM h, range(8) u(i)),
  x AS (SELECT task, r, v, sum("""
    + " + ".join(f"CAST(bits >= {c} AS INT)" for c in ranking.POISSON_CUTS)
    + """) AS wt FROM w GROUP BY task, r, v UNION ALL SELECT task, -1, v, count(*) FROM base GROUP BY task, v),
  c AS (SELECT task, r, v, sum(wt) OVER (PARTITION BY task, r ORDER BY v) AS upto, sum(wt) OVER (PARTITION BY task, r) AS total FROM x),
  q(quantile, p) AS (VALUES ('p50', 0.5::DOUBLE), ('p95', 0.95::DOUBLE), ('p99', 0.99::DOUBLE)),
  e AS (SELECT task, quantile, r, min(v) AS v FROM c, q WHERE total > 0 AND upto >= ceil(p * total) GROUP BY task, quantile, r),
  o AS (SELECT *, row_number() OVER (PARTITION BY task, quantile ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY task, quantile) AS k FROM e WHERE r >= 0)
  SELECT task, quantile, (SELECT count(*) FROM base b WHERE b.task = o.task) AS n, round((SELECT max(v) FROM e WHERE e.task = o.task AND e.quantile = o.quantile AND r = -1), 6) AS value,
    round(max(v) FILTER (WHERE i = floor(0.025::DOUBLE * (k - 1))), 6) AS ci_lower, round(max(v) FILTER (WHERE i = floor(0.975::DOUBLE * (k - 1))), 6) AS ci_upper FROM o GROUP BY task, quantile""",
)
def latency_percentile_ci(spark, d):
    e = wide(spark, d, "events", "event_type", "event_id", "value").withColumnRenamed("event_type", "task")
    return rounded(resample.bootstrap_quantiles(e, ["task"], F.col("event_id"), F.col("value") * 100, _PERCENTILES, resamples=64))


_RANKED_SQL = """e AS (SELECT event_type AS task, event_id, value AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b FROM events),
  r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY a DESC) + (count(*) OVER (PARTITION BY task, a) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (PARTITION BY task ORDER BY b DESC) + (count(*) OVER (PARTITION BY task, b) - 1) / 2.0::DOUBLE AS rb FROM e)"""


def _ranked(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("task"), "event_id", F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("bigint").alias("b"))


@query("request_ranks", f"WITH {_RANKED_SQL} SELECT task, event_id, ra AS latency_rank, rb AS k_rank FROM r")
def request_ranks(spark, d):
    out = resample.add_average_ranks(_ranked(spark, d), ["task"], {"latency_rank": "a", "k_rank": "b"})
    return out.select("task", "event_id", "latency_rank", "k_rank")


_ROW_DRAWS = 10_000


@query(
    "bootstrap_spearman_requests",
    f"""WITH {_RANKED_SQL}, n AS (SELECT task, a, b, row_number() OVER (PARTITION BY task ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY task) AS n FROM e),
  p AS (SELECT task, r, ('0x' || substr(md5('42|' || r || '|' || j), 1, 8))::BIGINT % n AS j, count(*) AS c FROM n, range({_ROW_DRAWS}) t(r) GROUP BY ALL),
  x AS (SELECT task, r, a, b, c FROM p JOIN n USING (task, j)),
  k AS (SELECT *, sum(c) OVER (PARTITION BY task, r ORDER BY a DESC) - (sum(c) OVER (PARTITION BY task, r, a) - 1) / 2.0::DOUBLE AS ra,
    sum(c) OVER (PARTITION BY task, r ORDER BY b DESC) - (sum(c) OVER (PARTITION BY task, r, b) - 1) / 2.0::DOUBLE AS rb FROM x),
  s AS (SELECT task, r, (sum(c) * sum(c * ra * rb) - sum(c * ra) * sum(c * rb)) / (sqrt(sum(c) * sum(c * ra * ra) - sum(c * ra) ** 2) * sqrt(sum(c) * sum(c * rb * rb) - sum(c * rb) ** 2)) AS rho FROM k GROUP BY ALL),
  o AS (SELECT task, rho, row_number() OVER (PARTITION BY task ORDER BY rho) - 1 AS i FROM s)
  SELECT task, (SELECT count(*) FROM e WHERE e.task = o.task) AS n, (SELECT round(corr(ra, rb), 6) FROM r WHERE r.task = o.task) AS rho,
    round(max(rho) FILTER (WHERE i = {int(0.025 * _ROW_DRAWS)}), 6) AS ci_lower, round(max(rho) FILTER (WHERE i = {min(int(0.975 * _ROW_DRAWS), _ROW_DRAWS - 1)}), 6) AS ci_upper FROM o GROUP BY task""",
)
def bootstrap_spearman_requests(spark, d):
    return rounded(resample.bootstrap_spearman_rows(_ranked(spark, d), ["task"], "event_id", "a", "b", resamples=_ROW_DRAWS).drop("p_value"))
