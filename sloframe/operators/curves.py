"""Training curves: run metrics, smoothing, learning speed, forgetting, decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach, decayed_baseline, exact_quantiles, first_rows, rolling_mean

# Class limits and default weights.
SUSTAINED_FINAL = 0.60
TRANSIENT_PEAK = 0.30
ROBUST_DELTA = -0.05
CATASTROPHIC_DELTA = -0.30
LEARNING_GAIN = 0.1
ROLLING_WIDTH = 50


def run_metrics(df: DataFrame, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per run: totals, validity over all / last 50 / last 100 steps, reward
    statistics, first and last ten rewards, latency and tokens.

    Whole-run figures reduce map-side. Head and tail come from per-run limits that
    Spark applies before the shuffle, so a very long run is never sorted in one task.
    """
    run = list(run)
    up = [F.col(c).asc() for c in order]
    down = [F.col(c).desc() for c in order]
    lat = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    tok = F.when(F.col("tokens_out") != 0, F.col("tokens_out"))
    zero = F.lit(0.0)
    base = df.groupBy(*run).agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.sum("json_valid").alias("json_valid_count"),
        (100.0 * F.avg("json_valid")).alias("json_valid_pct"),
        F.avg("reward").alias("avg_reward"),
        F.max("reward").alias("max_reward"),
        F.min("reward").alias("min_reward"),
        F.coalesce(F.when(F.count("reward") > 1, F.stddev_samp("reward")), zero).alias("reward_std"),
        F.coalesce(F.avg(lat), zero).alias("avg_latency_ms"),
        F.coalesce(F.avg(tok), zero).alias("avg_tokens_out"),
        F.coalesce(F.sum(tok), F.lit(0)).alias("total_tokens_out"),
    )
    head = first_rows(df.select(*run, *order, "reward"), run, up, 10).groupBy(*run).agg(F.avg("reward").alias("__head"))
    tail = first_rows(df.select(*run, *order, "reward", "json_valid"), run, down, 100).groupBy(*run).agg(
        F.avg(F.when(F.col("__rn") <= 10, F.col("reward"))).alias("__tail"),
        (100.0 * F.avg(F.when(F.col("__rn") <= 50, F.col("json_valid")))).alias("last_50_valid_pct"),
        (100.0 * F.avg("json_valid")).alias("last_100_valid_pct"),
    )
    out = attach(attach(base, head, run), tail, run)
    n, gain = F.col("total_steps"), F.col("__tail") - F.col("__head")
    return out.select(
        *base.columns,
        "last_50_valid_pct",
        "last_100_valid_pct",
        F.when(n >= 10, F.col("__head")).otherwise(zero).alias("first_10_avg_reward"),
        F.when(n >= 10, F.col("__tail")).otherwise(zero).alias("last_10_avg_reward"),
        F.when(n >= 20, gain).otherwise(zero).alias("reward_improvement"),
        ((n >= 20) & (gain > LEARNING_GAIN)).alias("learning_detected"),
    )


def run_latency(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """Median and index-rule p95 latency per run, missing and zero values left out."""
    lat = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    median = exact_quantiles(df, run, lat, {"p50_latency_ms": 0.5})
    p95 = exact_quantiles(df, run, lat, {"p95_latency_ms": 0.95}, "index_n_or_max_below_20")
    return attach(median, p95, run)


def last_n_validity(df: DataFrame, run: Sequence[str], order: Sequence[str], n: int = 50) -> DataFrame:
    """Mean validity over the last ``n`` steps of each run."""
    tail = first_rows(df.select(*run, *order, "json_valid"), run, [F.col(c).desc() for c in order], n)
    return tail.groupBy(*run).agg(F.avg("json_valid").alias("validity"))


def canonical_runs(runs: DataFrame, steps: int = 500, seeds: Sequence[int] = (42, 123, 456)) -> DataFrame:
    return runs.where((F.col("total_steps") == steps) & F.col("seed").isin(*seeds))


def long_runs(df: DataFrame, run: Sequence[str], at_least: int) -> DataFrame:
    """Step rows of runs with at least ``at_least`` steps."""
    big = df.groupBy(*run).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= at_least).select(*run)
    return df.join(big, list(run), "left_semi")


def _std(c: str) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def summaries(runs: DataFrame) -> DataFrame:
    """Per model, per task and overall, as grouping sets over the run table."""
    sets = runs.groupingSets([[F.col("model")], [F.col("task")], []], F.col("model"), F.col("task")).agg(
        F.grouping_id("model", "task").alias("__g"),
        F.count(F.lit(1)).alias("num_runs"),
        F.count_distinct(F.col("model")).alias("num_models"),
        F.count_distinct(F.col("task")).alias("num_tasks"),
        F.count_distinct(F.col("seed")).alias("num_seeds"),
        F.avg("last_50_valid_pct").alias("mean_valid_pct"),
        _std("last_50_valid_pct").alias("std_valid_pct"),
        F.min("last_50_valid_pct").alias("min_valid_pct"),
        F.max("last_50_valid_pct").alias("max_valid_pct"),
        F.avg("avg_reward").alias("mean_avg_reward"),
        _std("avg_reward").alias("std_avg_reward"),
        F.avg(F.col("learning_detected").cast("double")).alias("learning_rate"),
        F.sum("total_steps").alias("total_steps"),
    )
    level = F.when(F.col("__g") == 1, "model").when(F.col("__g") == 2, "task").otherwise("overall")
    return sets.withColumn("level", level).drop("__g")


def seed_aggregates(runs: DataFrame, by: Sequence[str], partial_below: float = 30.0) -> DataFrame:
    """Mean and deviation over runs with a small-sample warning and a verdict."""
    agg = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("last_50_valid_pct").alias("mean_pct"), _std("last_50_valid_pct").alias("std_pct")
    )
    mean = F.col("mean_pct")
    return agg.withColumn("few_seeds", F.col("n") < 3).withColumn(
        "learned", F.when(mean <= 0, "No").when(mean < partial_below, "Partial").otherwise("Yes")
    )


def decompose_reward(runs: DataFrame, by: Sequence[str], lam: float = 0.1, mu: float = 0.05, min_steps: int = 100) -> DataFrame:
    """Mean reward parts over runs that are long enough; the unexplained part is
    floored at 0 per run."""
    schema = F.col("json_valid_pct") / 100.0
    latency = -lam * F.col("avg_latency_ms") / 1000.0
    cost = -mu * F.col("avg_tokens_out") / 100.0
    parts = runs.where(F.col("total_steps") >= min_steps).select(
        *by,
        "avg_reward",
        schema.alias("r_schema"),
        latency.alias("r_latency"),
        cost.alias("r_cost"),
        F.greatest(F.lit(0.0), F.col("avg_reward") - schema - latency - cost).alias("r_residual"),
    )
    return parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("avg_reward").alias("mean_reward"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("r_schema", "r_residual", "r_latency", "r_cost")],
    )


def capacity(last: DataFrame, model: str = "model", task: str = "task", mixed: str = "Mixed") -> DataFrame:
    """Final validity per model and per (model, task) over single-task runs; ``total`` marks
    the model totals, as a model or task may be NULL. Deviations are over the population."""
    return (
        last.where(~F.col(task).eqNullSafe(F.lit(mixed)))
        .groupingSets([[F.col(model), F.col(task)], [F.col(model)]], F.col(model), F.col(task))
        .agg(
            F.avg("validity").alias("mean_validity"), F.stddev_pop("validity").alias("std_validity"), F.count(F.lit(1)).alias("n"),
            (F.grouping(task) == 1).alias("total"),
        )
    )


def capacity_zone(models: DataFrame, limit: float = 0.80) -> DataFrame:
    """Largest model below the limit and smallest at or above it."""
    at = F.struct("size_b", "model")
    below, above = F.col("mean_validity") < limit, F.col("mean_validity") >= limit
    row = F.struct("model", "size_b", "mean_validity")
    out = models.agg(
        F.max_by(F.when(below, row), F.when(below, at)).alias("low"), F.min_by(F.when(above, row), F.when(above, at)).alias("high")
    )
    return out.select(
        F.col("low.model").alias("low_model"), F.col("low.size_b").alias("low_size_b"), F.col("low.mean_validity").alias("low_validity"),
        F.col("high.model").alias("high_model"), F.col("high.size_b").alias("high_size_b"), F.col("high.mean_validity").alias("high_validity"),
    )


def profile(delta: Column, robust: Column | float = ROBUST_DELTA, catastrophic: Column | float = CATASTROPHIC_DELTA) -> Column:
    return F.when(delta > robust, "robust").when(delta > catastrophic, "selective").otherwise("catastrophic")


def forgetting(last: DataFrame, mixed: str = "Mixed") -> DataFrame:
    """Mixed-task against single-task final validity per model; models need both."""
    is_mixed = F.col("task") == mixed
    both = last.groupBy("model").agg(
        F.avg(F.when(is_mixed, F.col("validity"))).alias("mixed_validity"),
        F.stddev_pop(F.when(is_mixed, F.col("validity"))).alias("mixed_std"),
        F.avg(F.when(~is_mixed, F.col("validity"))).alias("single_validity"),
        F.stddev_pop(F.when(~is_mixed, F.col("validity"))).alias("single_std"),
    )
    delta = F.col("mixed_validity") - F.col("single_validity")
    return (
        both.where("mixed_validity is not null and single_validity is not null")
        .withColumn("delta", delta)
        .withColumn("profile", profile(F.col("delta")))
        .withColumn("verdict", F.when(F.col("delta") < -0.05, "forgetting").when(F.col("delta") > 0.05, "boost").otherwise("neutral"))
    )


def forgetting_by_task(last: DataFrame, mixed: str = "Mixed") -> DataFrame:
    """Single-task validity per (model, task) and mixed minus single."""
    per = last.groupBy("model", "task").agg(F.avg("validity").alias("v"))
    both = per.where(F.col("task") == mixed).select("model", F.col("v").alias("mixed_validity"))
    return per.where(F.col("task") != mixed).join(both, "model").select(
        "model", "task", F.col("v").alias("single_validity"), (F.col("mixed_validity") - F.col("v")).alias("task_delta")
    )


def forgetting_summary(matrix: DataFrame) -> DataFrame:
    # Four digits decide who is worst and best; ties go to the first model name.
    size = F.round(F.abs("delta"), 4)
    return matrix.agg(
        F.count(F.lit(1)).alias("n_models"),
        *[F.count_if(F.col("profile") == p).alias(p) for p in ("robust", "selective", "catastrophic")],
        F.min_by("model", F.struct(-size, F.col("model"))).alias("worst_forgetter"),
        F.min_by("model", F.struct(size, F.col("model"))).alias("best_retainer"),
        F.avg("delta").alias("avg_delta"),
    ).withColumn("trend", F.when(F.col("avg_delta") < -0.03, "forgetting").when(F.col("avg_delta") > 0.03, "transfer").otherwise("mixed"))


def smoothed(df: DataFrame, run: Sequence[str], pos: str, value: str = "json_valid", width: int = ROLLING_WIDTH) -> DataFrame:
    return rolling_mean(df, run, pos, F.col(value).cast("double"), width)


def steps_to_threshold(curve: DataFrame, run: Sequence[str], step: str, threshold: float = 0.5, value: str = "rolling") -> DataFrame:
    """First step at which the smoothed value reaches the threshold (NULL if never)."""
    return curve.groupBy(*run).agg(F.min(F.when(F.col(value) >= threshold, F.col(step))).alias("steps"))


def learning_speed(reached: DataFrame, by: Sequence[str]) -> DataFrame:
    return reached.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds_total"),
        F.count("steps").alias("seeds_reached"),
        F.avg("steps").alias("mean_steps"),
        F.stddev_pop("steps").alias("std_steps"),
        F.min("steps").alias("min_steps"),
        F.max("steps").alias("max_steps"),
    )


def speed_extremes(speed: DataFrame, task: str, model: str) -> DataFrame:
    """Fastest and slowest model per task among those that reach the threshold."""
    got = speed.where("mean_steps is not null")
    at = F.struct("mean_steps", model)
    return got.groupBy(task).agg(
        F.count(F.lit(1)).alias("models_reaching"), F.min_by(model, at).alias("fastest"), F.max_by(model, at).alias("slowest"), F.avg("mean_steps").alias("avg_steps")
    )


def align_seeds(curve: DataFrame, by: Sequence[str], seed: str, pos: str, step: str, value: str) -> DataFrame:
    """Mean and population deviation over seeds at each position, up to the length
    of the shortest seed; the step label is that of the lowest seed."""
    lengths = curve.groupBy(*by, seed).agg(F.max(pos).alias("__last")).groupBy(*by).agg(F.min("__last").alias("__stop"))
    common = attach(curve, lengths, by).where(F.col(pos) <= F.col("__stop"))
    return common.groupBy(*by, pos).agg(
        F.min_by(step, seed).alias("step_label"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n_seeds")
    )


def thin_and_pivot(curve: DataFrame, keys: Sequence[str], pos: str, column: str, names: Sequence[str], value: str, every: int = 10) -> DataFrame:
    """Every ``every``-th position, one column per name."""
    kept = curve.where(F.pmod(F.col(pos), F.lit(every)) == 0)
    return kept.groupBy(*keys, pos).pivot(column, list(names)).agg(F.avg(value))


def classify_curve(peak: Column, final: Column, sustained: Column | float = SUSTAINED_FINAL, transient: Column | float = TRANSIENT_PEAK) -> Column:
    return F.when(final >= sustained, "sustained").when(peak >= transient, "transient").otherwise("flat")


def curve_features(curve: DataFrame, by: Sequence[str], pos: str, step: str, value: str, min_points: int = 10) -> DataFrame:
    """Peak, its first step, final mean (last 50), decay from the peak, first step at
    half the peak, early mean (first 50), class. Curves below ``min_points`` are left out."""
    by = list(by)
    v = F.col(value)
    size = curve.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias("peak"))
    tagged = attach(curve.select(*by, pos, step, value), size.where(F.col("__n") >= min_points), by).where("__n is not null")
    feats = tagged.groupBy(*by).agg(
        F.max("peak").alias("peak"),
        F.max("__n").alias("n_points"),
        F.min_by(step, F.when(v == F.col("peak"), F.col(pos))).alias("peak_step"),
        F.min(F.when(v == F.col("peak"), F.col(pos))).alias("__at"),
        F.avg(F.when(F.col(pos) >= F.col("__n") - 50, v)).alias("final"),
        F.min_by(step, F.when(v >= 0.5 * F.col("peak"), F.col(pos))).alias("half_peak_step"),
        F.avg(F.when(F.col(pos) < 50, v)).alias("early_mean_50"),
    )
    decay = F.when((F.col("__at") < F.col("n_points") - 1) & (F.col("peak") > 0), (F.col("peak") - F.col("final")) / F.col("peak")).otherwise(F.lit(0.0))
    return feats.withColumn("decay_rate", decay).withColumn("category", classify_curve(F.col("peak"), F.col("final"))).drop("__at")


def taxonomy_counts(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    return curves.groupBy(*by).pivot("category", ["sustained", "transient", "flat"]).agg(F.count(F.lit(1))).na.fill(0)


def running_advantage(df: DataFrame, run: Sequence[str], pos: str, reward: str = "reward", keep: float = 0.9) -> DataFrame:
    """Exponential reward baseline before each step and the step's advantage."""
    out = decayed_baseline(df, run, pos, F.col(reward), keep)
    return out.withColumn("advantage", F.col(reward) - F.col("baseline"))


def first_last(curve: DataFrame, by: Sequence[str], pos: str, value: str) -> DataFrame:
    """Value at the first and the last position and their difference."""
    out = curve.groupBy(*by).agg(F.min_by(value, pos).alias("first_value"), F.max_by(value, pos).alias("last_value"))
    return out.withColumn("delta", F.col("last_value") - F.col("first_value"))
