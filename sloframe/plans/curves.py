"""Queries: training curves, forgetting, sensitivity, early prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sloframe.operators import curves, predict, sensitivity
from sloframe.operators.joins import lookup
from sloframe.plans.registry import query, rounded
from sloframe.plans.views import MODEL_DIM_SQL, RUN, STEPS_SQL, model_dim, steps, steps_raw

H = f"WITH {STEPS_SQL}"

_RUNS = """n AS (SELECT *, count(*) OVER (PARTITION BY model, task, seed) AS n FROM steps),
runs AS (SELECT model, task, seed, count(*) AS total_steps, sum(json_valid) AS json_valid_count, 100 * avg(json_valid) AS json_valid_pct,
  100 * avg(json_valid) FILTER (WHERE step >= n - 50) AS last_50_valid_pct, 100 * avg(json_valid) FILTER (WHERE step >= n - 100) AS last_100_valid_pct,
  avg(reward) AS avg_reward, max(reward) AS max_reward, min(reward) AS min_reward, coalesce(stddev_samp(reward), 0) AS reward_std,
  CASE WHEN count(*) >= 10 THEN avg(reward) FILTER (WHERE step < 10) ELSE 0 END AS first_10_avg_reward,
  CASE WHEN count(*) >= 10 THEN avg(reward) FILTER (WHERE step >= n - 10) ELSE 0 END AS last_10_avg_reward,
  CASE WHEN count(*) >= 20 THEN avg(reward) FILTER (WHERE step >= n - 10) - avg(reward) FILTER (WHERE step < 10) ELSE 0 END AS reward_improvement,
  count(*) >= 20 AND avg(reward) FILTER (WHERE step >= n - 10) - avg(reward) FILTER (WHERE step < 10) > 0.1 AS learning_detected,
  coalesce(avg(nullif(latency_ms, 0)), 0) AS avg_latency_ms, coalesce(avg(nullif(tokens_out, 0)), 0) AS avg_tokens_out, coalesce(sum(nullif(tokens_out, 0)), 0) AS total_tokens_out
  FROM n GROUP BY model, task, seed)"""


def _runs(spark, d):
    return curves.run_metrics(steps_raw(spark, d), RUN, ["at"])


_RUN_COLS = ["json_valid_pct", "last_50_valid_pct", "last_100_valid_pct", "avg_reward", "max_reward", "min_reward", "reward_std",
             "first_10_avg_reward", "last_10_avg_reward", "reward_improvement", "avg_latency_ms", "avg_tokens_out"]


@query(
    "run_metrics",
    f"{H}, {_RUNS} SELECT model, task, seed, total_steps, CAST(json_valid_count AS BIGINT) AS json_valid_count, CAST(total_tokens_out AS BIGINT) AS total_tokens_out, learning_detected, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _RUN_COLS) + " FROM runs",
)
def run_metrics(spark, d):
    return rounded(_runs(spark, d))


@query(
    "run_latency",
    f"{H}, l AS (SELECT model, task, seed, latency_ms, row_number() OVER (PARTITION BY model, task, seed ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model, task, seed) AS m FROM steps WHERE latency_ms IS NOT NULL AND latency_ms <> 0)" + """
  SELECT model, task, seed, round(median(latency_ms), 6) AS p50_latency_ms, round(max(latency_ms) FILTER (WHERE i = CASE WHEN m >= 20 THEN floor(0.95::DOUBLE * m) ELSE m - 1 END), 6) AS p95_latency_ms FROM l GROUP BY ALL""",
)
def run_latency(spark, d):
    return rounded(curves.run_latency(steps_raw(spark, d), RUN))


@query(
    "run_filter",
    f"{H}, r AS (SELECT model, task, seed, count(*) AS total_steps FROM steps GROUP BY ALL) SELECT model, task, seed, total_steps FROM r WHERE total_steps >= 60 AND seed IN (0, 2)",
)
def run_filter(spark, d):
    big = curves.long_runs(steps_raw(spark, d), RUN, 60)
    return big.where(F.col("seed").isin(0, 2)).groupBy(*RUN).agg(F.count(F.lit(1)).alias("total_steps"))


@query(
    "grouping_summary",
    f"{H}, {_RUNS} SELECT model, task, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(task) = 0 THEN 'task' ELSE 'overall' END AS level, count(*) AS num_runs,"
    " count(DISTINCT model) AS num_models, count(DISTINCT task) AS num_tasks, count(DISTINCT seed) AS num_seeds, round(avg(last_50_valid_pct), 6) AS mean_valid_pct,"
    " round(coalesce(stddev_samp(last_50_valid_pct), 0), 6) AS std_valid_pct, round(min(last_50_valid_pct), 6) AS min_valid_pct, round(max(last_50_valid_pct), 6) AS max_valid_pct,"
    " round(avg(avg_reward), 6) AS mean_avg_reward, round(coalesce(stddev_samp(avg_reward), 0), 6) AS std_avg_reward, round(avg(CAST(learning_detected AS INT)), 6) AS learning_rate,"
    " CAST(sum(total_steps) AS BIGINT) AS total_steps FROM runs GROUP BY GROUPING SETS ((model), (task), ())",
)
def grouping_summary(spark, d):
    return rounded(curves.summaries(_runs(spark, d)))


@query(
    "seed_aggregate",
    f"{H}, {_RUNS} SELECT model, task, count(*) AS n, round(avg(last_50_valid_pct), 6) AS mean_pct, round(coalesce(stddev_samp(last_50_valid_pct), 0), 6) AS std_pct, count(*) < 3 AS few_seeds,"
    " CASE WHEN avg(last_50_valid_pct) <= 0 THEN 'No' WHEN avg(last_50_valid_pct) < 30 THEN 'Partial' ELSE 'Yes' END AS learned FROM runs GROUP BY model, task",
)
def seed_aggregate(spark, d):
    return rounded(curves.seed_aggregates(_runs(spark, d), ["model", "task"]))


@query(
    "reward_decomposition",
    f"{H}, {_RUNS}, p AS (SELECT model, avg_reward, json_valid_pct / 100 AS r_schema, -0.1::DOUBLE * avg_latency_ms / 1000 AS r_latency, -0.05::DOUBLE * avg_tokens_out / 100 AS r_cost FROM runs WHERE total_steps >= 60)"
    " SELECT model, count(*) AS n_runs, round(avg(avg_reward), 6) AS mean_reward, round(avg(r_schema), 6) AS mean_r_schema, round(avg(greatest(0, avg_reward - r_schema - r_latency - r_cost)), 6) AS mean_r_residual,"
    " round(avg(r_latency), 6) AS mean_r_latency, round(avg(r_cost), 6) AS mean_r_cost FROM p GROUP BY model",
)
def reward_decomposition(spark, d):
    return rounded(curves.decompose_reward(_runs(spark, d), ["model"], min_steps=60))


_LAST = """n AS (SELECT *, count(*) OVER (PARTITION BY model, task, seed) AS n FROM steps),
last AS (SELECT model, task, seed, avg(json_valid) AS validity FROM n WHERE step >= n - 50 GROUP BY ALL)"""


def _last(spark, d):
    return curves.last_n_validity(steps_raw(spark, d), RUN, ["at"])


@query(
    "capacity_curve",
    f"{H}, {_LAST} SELECT model, task, round(avg(validity), 6) AS mean_validity, round(stddev_pop(validity), 6) AS std_validity, count(*) AS n, GROUPING(task) = 1 AS total FROM (SELECT * REPLACE (CASE WHEN task = 'signup' THEN NULL ELSE task END AS task) FROM last) WHERE task IS DISTINCT FROM 'Mixed' GROUP BY GROUPING SETS ((model, task), (model))",
)
def capacity_curve(spark, d):
    return rounded(curves.capacity(_last(spark, d).withColumn("task", F.when(F.col("task") != "signup", F.col("task")))))


@query(
    "capacity_zone",
    f"{H}, {_LAST}, {MODEL_DIM_SQL}, c AS (SELECT model, size_b, avg(validity) AS v FROM last JOIN model_dim USING (model) WHERE task <> 'Mixed' GROUP BY ALL),"
    " lo AS (SELECT * FROM c WHERE v < 0.485 ORDER BY size_b DESC, model DESC LIMIT 1), hi AS (SELECT * FROM c WHERE v >= 0.485 ORDER BY size_b, model LIMIT 1)"
    " SELECT lo.model AS low_model, lo.size_b AS low_size_b, round(lo.v, 6) AS low_validity, hi.model AS high_model, hi.size_b AS high_size_b, round(hi.v, 6) AS high_validity FROM lo FULL JOIN hi ON true",
)
def capacity_zone(spark, d):
    per = curves.capacity(_last(spark, d)).where("total").select("model", "mean_validity")
    return rounded(curves.capacity_zone(lookup(per, model_dim(spark), "model", ["size_b"], keep_unknown=False), 0.485))


_FORGET = f"""{_LAST}, f AS (SELECT model, avg(validity) FILTER (WHERE task = 'Mixed') AS mixed_validity, stddev_pop(validity) FILTER (WHERE task = 'Mixed') AS mixed_std,
  avg(validity) FILTER (WHERE task <> 'Mixed') AS single_validity, stddev_pop(validity) FILTER (WHERE task <> 'Mixed') AS single_std FROM last GROUP BY model),
  m AS (SELECT *, mixed_validity - single_validity AS delta FROM f WHERE mixed_validity IS NOT NULL AND single_validity IS NOT NULL),
  g AS (SELECT *, CASE WHEN delta > -0.05::DOUBLE THEN 'robust' WHEN delta > -0.30::DOUBLE THEN 'selective' ELSE 'catastrophic' END AS profile,
    CASE WHEN delta < -0.05::DOUBLE THEN 'forgetting' WHEN delta > 0.05::DOUBLE THEN 'boost' ELSE 'neutral' END AS verdict FROM m)"""


@query(
    "forgetting",
    f"{H}, {_FORGET} SELECT model, round(mixed_validity, 6) AS mixed_validity, round(mixed_std, 6) AS mixed_std, round(single_validity, 6) AS single_validity, round(single_std, 6) AS single_std, round(delta, 6) AS delta, profile, verdict FROM g",
)
def forgetting(spark, d):
    return rounded(curves.forgetting(_last(spark, d)))


@query(
    "forgetting_by_task",
    f"{H}, {_LAST}, p AS (SELECT model, task, avg(validity) AS v FROM last GROUP BY ALL) SELECT s.model, s.task, round(s.v, 6) AS single_validity, round(x.v - s.v, 6) AS task_delta FROM p s JOIN p x ON x.model = s.model AND x.task = 'Mixed' WHERE s.task <> 'Mixed'",
)
def forgetting_by_task(spark, d):
    return rounded(curves.forgetting_by_task(_last(spark, d)))


@query(
    "forgetting_summary",
    f"{H}, {_FORGET} SELECT count(*) AS n_models, count(*) FILTER (WHERE profile = 'robust') AS robust, count(*) FILTER (WHERE profile = 'selective') AS selective, count(*) FILTER (WHERE profile = 'catastrophic') AS catastrophic,"
    " (SELECT model FROM g ORDER BY round(abs(delta), 4) DESC, model LIMIT 1) AS worst_forgetter, (SELECT model FROM g ORDER BY round(abs(delta), 4), model LIMIT 1) AS best_retainer, round(avg(delta), 6) AS avg_delta,"
    " CASE WHEN avg(delta) < -0.03 THEN 'forgetting' WHEN avg(delta) > 0.03 THEN 'transfer' ELSE 'mixed' END AS trend FROM g",
)
def forgetting_summary(spark, d):
    return rounded(curves.forgetting_summary(curves.forgetting(_last(spark, d))))


_ROLL = "roll AS (SELECT *, avg(json_valid) OVER (PARTITION BY model, task, seed ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling FROM steps)"


def _roll(spark, d):
    return curves.smoothed(steps(spark, d), RUN, "step")


@query("rolling_validity", f"{H}, {_ROLL} SELECT model, task, seed, step, round(rolling, 6) AS rolling FROM roll")
def rolling_validity(spark, d):
    return rounded(_roll(spark, d).select(*RUN, "step", "rolling"))


_SPEED = """reach AS (SELECT model, task, seed, min(step) FILTER (WHERE rolling >= 0.5) AS steps FROM roll GROUP BY ALL),
  speed AS (SELECT task, model, count(*) AS seeds_total, count(steps) AS seeds_reached, avg(steps) AS mean_steps, stddev_pop(steps) AS std_steps, min(steps) AS min_steps, max(steps) AS max_steps FROM reach GROUP BY ALL)"""


@query(
    "steps_to_threshold",
    f"{H}, {_ROLL}, {_SPEED} SELECT task, model, seeds_total, seeds_reached, round(mean_steps, 6) AS mean_steps, round(std_steps, 6) AS std_steps, min_steps, max_steps FROM speed",
)
def steps_to_threshold(spark, d):
    return rounded(curves.learning_speed(curves.steps_to_threshold(_roll(spark, d), RUN, "step"), ["task", "model"]))


@query(
    "speed_extremes",
    f"{H}, {_ROLL}, {_SPEED}, g AS (SELECT * FROM speed WHERE mean_steps IS NOT NULL) SELECT task, count(*) AS models_reaching, arg_min(model, (mean_steps, model)) AS fastest, arg_max(model, (mean_steps, model)) AS slowest, round(avg(mean_steps), 6) AS avg_steps FROM g GROUP BY task",
)
def speed_extremes(spark, d):
    speed = curves.learning_speed(curves.steps_to_threshold(_roll(spark, d), RUN, "step"), ["task", "model"])
    return rounded(curves.speed_extremes(speed, "task", "model"))


_ALIGN = """len AS (SELECT model, task, min(l) AS stop FROM (SELECT model, task, seed, max(step) AS l FROM steps GROUP BY ALL) GROUP BY ALL),
  al AS (SELECT model, task, step AS pos, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n_seeds FROM (SELECT model, task, step, {v} AS v FROM {t}) JOIN len USING (model, task) WHERE step <= stop GROUP BY ALL)"""


@query(
    "seed_aligned_curve",
    f"{H}, {_ALIGN.format(v='reward', t='steps')} SELECT model, task, pos, pos AS step_label, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds FROM al",
)
def seed_aligned_curve(spark, d):
    s = steps(spark, d).withColumn("pos", F.col("step"))
    return rounded(curves.align_seeds(s, ["model", "task"], "seed", "pos", "step", "reward"))


_MODELS = [f"m{i}" for i in range(11)]


@query(
    "thinned_curve_pivot",
    f"{H}, {_ALIGN.format(v='reward', t='steps')} SELECT task, pos, " + ", ".join(f"round(max(mean) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in _MODELS) + " FROM al WHERE pos % 10 = 0 GROUP BY task, pos",
)
def thinned_curve_pivot(spark, d):
    s = steps(spark, d).withColumn("pos", F.col("step"))
    aligned = curves.align_seeds(s, ["model", "task"], "seed", "pos", "step", "reward")
    return rounded(curves.thin_and_pivot(aligned, ["task"], "pos", "model", _MODELS, "mean"))


@query(
    "learning_trajectory",
    f"{H}, {_ALIGN.format(v='reward', t='steps')} SELECT model, task, round(arg_min(mean, pos), 6) AS first_value, round(arg_max(mean, pos), 6) AS last_value, round(arg_max(mean, pos) - arg_min(mean, pos), 6) AS delta FROM al GROUP BY ALL",
)
def learning_trajectory(spark, d):
    s = steps(spark, d).withColumn("pos", F.col("step"))
    return rounded(curves.first_last(curves.align_seeds(s, ["model", "task"], "seed", "pos", "step", "reward"), ["model", "task"], "pos", "mean"))


_FEATS = """{al}, sz AS (SELECT model, task, count(*) AS np, max(mean) AS peak FROM al GROUP BY ALL HAVING count(*) >= 10),
  fe AS (SELECT model, task, max(np) AS n_points, max(peak) AS peak, min(pos) FILTER (WHERE mean = peak) AS peak_step, avg(mean) FILTER (WHERE pos >= np - 50) AS final,
    min(pos) FILTER (WHERE mean >= 0.5::DOUBLE * peak) AS half_peak_step, avg(mean) FILTER (WHERE pos < 50) AS early_mean_50 FROM al JOIN sz USING (model, task) GROUP BY ALL),
  feats AS (SELECT *, CASE WHEN peak_step < n_points - 1 AND peak > 0 THEN (peak - final) / peak ELSE 0 END AS decay_rate,
    CASE WHEN final >= 0.6::DOUBLE THEN 'sustained' WHEN peak >= 0.3::DOUBLE THEN 'transient' ELSE 'flat' END AS category FROM fe)""".format(
    al=_ALIGN.format(v="rolling", t="roll")
)


def _features(spark, d):
    roll = _roll(spark, d).withColumn("pos", F.col("step"))
    aligned = curves.align_seeds(roll, ["model", "task"], "seed", "pos", "step", "rolling")
    # Exact float ties decide the peak step, so the curve is compared at 9 digits.
    aligned = aligned.withColumn("mean", F.round("mean", 9))
    return curves.curve_features(aligned, ["model", "task"], "pos", "step_label", "mean")


_FEATS9 = _FEATS.replace("avg(v) AS mean", "round(avg(v), 9) AS mean")


@query(
    "curve_taxonomy",
    f"{H}, {_ROLL}, {_FEATS9} SELECT model, task, n_points, round(peak, 6) AS peak, peak_step, round(final, 6) AS final, half_peak_step, round(early_mean_50, 6) AS early_mean_50, round(decay_rate, 6) AS decay_rate, category FROM feats",
)
def curve_taxonomy(spark, d):
    return rounded(_features(spark, d))


@query(
    "taxonomy_counts",
    f"{H}, {_ROLL}, {_FEATS9}, {MODEL_DIM_SQL} SELECT CASE WHEN size_b <= 3 THEN 'small' WHEN size_b <= 7 THEN 'medium' ELSE 'large' END AS size_range, count(*) FILTER (WHERE category = 'sustained') AS sustained,"
    " count(*) FILTER (WHERE category = 'transient') AS transient, count(*) FILTER (WHERE category = 'flat') AS flat FROM feats JOIN model_dim USING (model) GROUP BY 1",
)
def taxonomy_counts(spark, d):
    from sloframe.functions.text import size_bucket

    f = lookup(_features(spark, d), model_dim(spark), "model", ["size_b"], keep_unknown=False)
    return curves.taxonomy_counts(f.withColumn("size_range", size_bucket(F.col("size_b"))), ["size_range"])


@query(
    "ema_advantage",
    f"{H}, b AS (SELECT s.model, s.task, s.seed, s.step, s.reward, coalesce(sum(0.1::DOUBLE * 0.9::DOUBLE ** (s.step - p.step - 1) * p.reward), 0) AS baseline FROM steps s LEFT JOIN steps p"
    " ON p.model = s.model AND p.task = s.task AND p.seed = s.seed AND p.step < s.step GROUP BY ALL)"
    " SELECT model, task, seed, step, round(baseline, 6) AS baseline, round(reward - baseline, 6) AS advantage FROM b",
)
def ema_advantage(spark, d):
    return rounded(curves.running_advantage(steps(spark, d), RUN, "step").select(*RUN, "step", "baseline", "advantage"))


_POINTS = sorted({(s, t) for s in sensitivity.JOINT_SUSTAINED for t in sensitivity.JOINT_TRANSIENT} | {(s, 0.30) for s in sensitivity.SUSTAINED_SWEEP} | {(0.60, t) for t in sensitivity.TRANSIENT_SWEEP})


@query(
    "threshold_sensitivity",
    f"{H}, {_ROLL}, {_FEATS9}, grid(s, t) AS (VALUES " + ", ".join(f"({s}::DOUBLE, {t}::DOUBLE)" for s, t in _POINTS) + "),"
    " x AS (SELECT s, t, CASE WHEN final >= s THEN 'sustained' WHEN peak >= t THEN 'transient' ELSE 'flat' END AS now, category AS was FROM feats, grid WHERE task <> 'Mixed')"
    " SELECT s AS sustained_at, t AS transient_at, count(*) AS n, count(*) FILTER (WHERE now = 'sustained') AS sustained, count(*) FILTER (WHERE now = 'transient') AS transient, count(*) FILTER (WHERE now = 'flat') AS flat,"
    " count(*) FILTER (WHERE now <> was) AS changes, round(100.0::DOUBLE * count(*) FILTER (WHERE now = was) / count(*), 6) AS pct_stable FROM x GROUP BY s, t",
)
def threshold_sensitivity(spark, d):
    return rounded(sensitivity.curve_sweep(_features(spark, d).where("task <> 'Mixed'")))


@query(
    "stable_curves",
    f"{H}, {_ROLL}, {_FEATS9}, c AS (SELECT (final >= 0.5::DOUBLE) = (final >= 0.7::DOUBLE) AS same FROM feats)"
    " SELECT count(*) AS n_curves, count(*) FILTER (WHERE same) AS n_stable, round(100.0::DOUBLE * count(*) FILTER (WHERE same) / count(*), 6) AS pct_stable FROM c",
)
def stable_curves(spark, d):
    return rounded(sensitivity.stable_curves(_features(spark, d), ["model", "task"]))


@query(
    "forgetting_sensitivity",
    f"{H}, {_FORGET}, o(x) AS (VALUES (-0.05::DOUBLE), (-0.03::DOUBLE), (0.0::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE)), p AS (SELECT -0.05::DOUBLE + a.x AS r, -0.30::DOUBLE + b.x AS c FROM o a, o b),"
    " z AS (SELECT r, c, profile AS was, CASE WHEN delta > r THEN 'robust' WHEN delta > c THEN 'selective' ELSE 'catastrophic' END AS now FROM g, p)"
    " SELECT round(r, 3) AS robust_at, round(c, 3) AS catastrophic_at, count(*) AS n, count(*) FILTER (WHERE now = 'robust') AS robust, count(*) FILTER (WHERE now = 'selective') AS selective,"
    " count(*) FILTER (WHERE now = 'catastrophic') AS catastrophic, count(*) FILTER (WHERE now <> was) AS changes FROM z GROUP BY 1, 2",
)
def forgetting_sensitivity(spark, d):
    return sensitivity.forgetting_sweep(curves.forgetting(_last(spark, d)))


# ---- prediction -------------------------------------------------------------


def _outcomes(spark, d):
    """Run-grain features. The outcome is final validity above the overall middle,
    so that both classes occur in the driver tables."""
    f = _features(spark, d).withColumn("category", F.when(F.col("final") >= 0.49, "sustained").otherwise("transient"))
    return predict.outcome_features(f, model_dim(spark))


_W = ["w0", "w1", "w2", "w3"]  # weights of the three features and the bias


def _newton_sql(train: str, steps: int = predict.STEPS, penalty: float = predict.PENALTY) -> str:
    """Newton steps for all folds, written out. Reads ``rows_`` (x0 to x2, x3 = 1, y, fold) and
    ``folds``; ``train`` says whether row r is trained on for fold m."""
    out = ["m0 AS (SELECT fold, " + ", ".join(f"0.0::DOUBLE AS {w}" for w in _W) + " FROM folds)"]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    for t in range(1, steps + 1):
        z = " + ".join(f"m.w{i} * r.x{i}" for i in range(4))
        sums = [f"sum((p - y) * x{i}) / count(*) AS g{i}" for i in range(4)] + [f"sum(p * (1 - p) * x{i} * x{j}) / count(*) AS h{i}{j}" for i, j in upper]
        out.append(f"e{t} AS (SELECT m.*, r.x0, r.x1, r.x2, r.x3, r.y, 1 / (1 + exp(-({z}))) AS p FROM m{t - 1} m JOIN rows_ r ON {train})")
        out.append(f"s{t} AS (SELECT fold, {', '.join(_W)}, sum(y) AS ones, count(*) AS n, {', '.join(sums)} FROM e{t} GROUP BY fold, {', '.join(_W)})")
        # Elimination without pivots: the matrix is symmetric and positive definite.
        rows = [[f"h{min(i, j)}{max(i, j)}" + (f" + {penalty}::DOUBLE" if i == j < 3 else "") for j in range(4)] + [f"g{i}" + (f" + {penalty}::DOUBLE * w{i}" if i < 3 else "")] for i in range(4)]
        cte, source = ", ".join(f"{rows[i][j]} AS a{i}{j}" for i in range(4) for j in range(5)), f"s{t}"
        out.append(f"a{t}_0 AS (SELECT fold, {', '.join(_W)}, ones, n, {cte} FROM {source})")
        for k in range(3):
            cells = ", ".join((f"a{i}{j} - a{i}{k} * a{k}{j} / nullif(a{k}{k}, 0) AS a{i}{j}" if i > k and j >= k else f"a{i}{j}") for i in range(4) for j in range(5))
            out.append(f"a{t}_{k + 1} AS (SELECT fold, {', '.join(_W)}, ones, n, {cells} FROM a{t}_{k})")
        out.append(f"b{t}_3 AS (SELECT *, a34 / nullif(a33, 0) AS d3 FROM a{t}_3)")
        for k in (2, 1, 0):
            less = "".join(f" - a{k}{j} * d{j}" for j in range(k + 1, 4))
            out.append(f"b{t}_{k} AS (SELECT *, (a{k}4{less}) / nullif(a{k}{k}, 0) AS d{k} FROM b{t}_{k + 1})")
        cut = f"least(1.0::DOUBLE, {predict.LONGEST_STEP}::DOUBLE / greatest(sqrt(d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3), 1e-300::DOUBLE))"
        moved = ", ".join(f"CASE WHEN ones IN (0, n) OR d0 IS NULL THEN w{i} ELSE w{i} - d{i} * {cut} END AS w{i}" for i in range(4))
        out.append(f"m{t} AS MATERIALIZED (SELECT fold, {moved} FROM b{t}_0)")
    z = " + ".join(f"m.w{i} * r.x{i}" for i in range(4))
    share = f"CASE WHEN s.n = s.ones THEN 1.0 WHEN s.ones = 0 THEN 0.0 ELSE 1 / (1 + exp(-({z}))) END"
    out.append(f"""scored AS (SELECT r.model, r.task, r.family, r.y AS label, {share} AS probability, CAST({share} >= 0.5 AS INT)::DOUBLE AS prediction
      FROM rows_ r LEFT JOIN m{steps} m ON m.fold = r.fold LEFT JOIN s{steps} s ON s.fold = r.fold)""")
    return ", ".join(out)


def _rows_sql(fold: str) -> str:
    return f"""{MODEL_DIM_SQL}, rows_ AS MATERIALIZED (SELECT model, task, coalesce(family, 'unknown') AS family, coalesce(early_mean_50, 0) AS x0, coalesce(peak_step, 0) / 1000.0::DOUBLE AS x1,
      coalesce(size_b, 5) / 12.0::DOUBLE AS x2, 1.0::DOUBLE AS x3, CAST(final >= 0.49 AS INT)::DOUBLE AS y, {fold} AS fold FROM feats LEFT JOIN model_dim USING (model)),
      folds AS (SELECT DISTINCT fold FROM rows_)"""


_IN_SAMPLE = f"{H}, {_ROLL}, {_FEATS9}, {_rows_sql('0')}, {_newton_sql('true')}"
_LEFT_OUT = "r.fold <> m.fold"
_ACCURACY = "count(*) AS n, CAST(sum(CAST(prediction = label AS INT)) AS BIGINT) AS correct, round(avg(CAST(prediction = label AS INT)), 6) AS accuracy"


@query("early_prediction", f"{_IN_SAMPLE} SELECT model, task, label, prediction FROM scored")
def early_prediction(spark, d):
    return predict.in_sample(_kept(spark, _outcomes(spark, d))).select("model", "task", "label", "prediction")


@query(
    "early_prediction_model",
    f"{_IN_SAMPLE} SELECT " + ", ".join(f"round(w{i}, 6) AS {n}" for i, n in enumerate([*predict.FEATURES, "bias"]))
    + f", (SELECT count(*) FROM rows_) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM rows_) AS n_sustained FROM m{predict.STEPS}",
)
def early_prediction_model(spark, d):
    model = predict.fitted(_kept(spark, _outcomes(spark, d)))
    weights = [F.col("weights")[i].alias(n) for i, n in enumerate([*predict.FEATURES, "bias"])]
    return rounded(model.select(*weights, "n", F.col("ones").alias("n_sustained")))


def _kept(spark, df):
    """Feature table with its lineage cut, as fit and prediction read it again."""
    from sloframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return df.checkpoint()


@query("leave_family_out", f"{H}, {_ROLL}, {_FEATS9}, {_rows_sql('dense_rank() OVER (ORDER BY family NULLS FIRST)')}, {_newton_sql(_LEFT_OUT)} SELECT family, {_ACCURACY} FROM scored GROUP BY family")
def leave_family_out(spark, d):
    out = predict.leave_group_out(_kept(spark, _outcomes(spark, d)), "family")
    return rounded(predict.group_accuracy(out, ["family"]))


_MD5_FOLD = "('0x' || substr(md5(model || '|' || task), 1, 8))::BIGINT % 5"


@query("cross_validated_accuracy", f"{H}, {_ROLL}, {_FEATS9}, {_rows_sql(_MD5_FOLD)}, {_newton_sql(_LEFT_OUT)} SELECT {_ACCURACY} FROM scored")
def cross_validated_accuracy(spark, d):
    out = predict.leave_fold_out(_kept(spark, _outcomes(spark, d)), ["model", "task"], 5)
    return rounded(predict.group_accuracy(out, []))


@query("leave_one_out", f"{H}, {_ROLL}, {_FEATS9}, {_rows_sql('row_number() OVER (ORDER BY model, task)')}, {_newton_sql(_LEFT_OUT)} SELECT model, task, label, round(probability, 6) AS probability, prediction FROM scored")
def leave_one_out(spark, d):
    out = predict.leave_one_out(_kept(spark, _outcomes(spark, d)))
    return rounded(out.select("model", "task", "label", "probability", "prediction"))


@query(
    "prediction_by_model",
    f"{_IN_SAMPLE} SELECT model, {_ACCURACY}, string_agg(task || ':' || CAST(prediction AS INT) || '/' || CAST(label AS INT), ',' ORDER BY task) AS predictions FROM scored GROUP BY model",
)
def prediction_by_model(spark, d):
    out = predict.prediction_lists(predict.in_sample(_kept(spark, _outcomes(spark, d))), ["model"], "task")
    shown = F.transform("predictions", lambda p: F.concat(p["task"], F.lit(":"), p["predicted"].cast("string"), F.lit("/"), p["actual"].cast("string")))
    return rounded(out.withColumn("predictions", F.array_join(shown, ",")))


_OUT = "out AS (SELECT model, task, early_mean_50 AS early, CAST(final >= 0.49 AS INT)::DOUBLE AS label FROM feats)"


@query(
    "majority_baseline",
    f"{H}, {_ROLL}, {_FEATS9}, {_OUT} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_sustained, round(greatest(sum(label), count(*) - sum(label)) / count(*), 6) AS baseline_accuracy FROM out",
)
def majority_baseline(spark, d):
    return rounded(predict.majority_baseline(_outcomes(spark, d)))


@query(
    "early_stop_rule",
    f"{H}, {_ROLL}, {_FEATS9}, {_OUT}, s AS (SELECT CASE WHEN early < 0.47::DOUBLE THEN 'below' ELSE 'above' END AS side, count(*) AS n, sum(label) AS k FROM out GROUP BY 1)"
    " SELECT side, n, CAST(k AS BIGINT) AS sustained, round(k / n, 6) AS sustained_ratio, CAST(n - k AS BIGINT) AS not_sustained, CASE WHEN side = 'below' THEN 1 - k / n > 0.8 END AS rule_holds FROM s",
)
def early_stop_rule(spark, d):
    return rounded(predict.stop_rule(_outcomes(spark, d), "early_mean_50", limit=0.47))
