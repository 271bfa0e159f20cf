"""Latency tiers, success under a deadline, summaries and latency distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach, exact_quantiles

# Deadline tiers in milliseconds.
TIERS: tuple[tuple[str, float], ...] = (("interactive", 2000.0), ("standard", 5000.0), ("batch", 30000.0))


def tier_flags(latency: Column, correct: Column, valid: Column, deadline: Column | float) -> Column:
    """Struct of 0/1 doubles for one deadline; missing values count as failed."""
    on_time = F.coalesce(latency <= deadline, F.lit(False))
    ok = F.coalesce(correct, F.lit(False))
    parsed = F.coalesce(valid, F.lit(False))
    return F.struct(
        on_time.cast("double").alias("on_time"),
        ok.cast("double").alias("correct"),
        parsed.cast("double").alias("json_valid"),
        (on_time & ok & parsed).cast("double").alias("success_at_slo"),
    )


def _tier_aggs(tiers: Sequence[tuple[str, float]], latency: str, correct: str, valid: str) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(F.col(correct)).alias("correct")]
    for i, (_, deadline) in enumerate(tiers):
        on_time = F.col(latency) <= deadline
        aggs += [
            F.count_if(on_time).alias(f"__on{i}"),
            F.count_if(on_time & F.col(correct) & F.col(valid)).alias(f"__ok{i}"),
        ]
    return aggs


def _stack_tiers(counts: DataFrame, keys: Sequence[str], tiers: Sequence[tuple[str, float]]) -> DataFrame:
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("tier"),
                    F.lit(float(deadline)).alias("deadline_ms"),
                    F.col(f"__on{i}").alias("on_time"),
                    F.col(f"__ok{i}").alias("success_at_slo"),
                )
                for i, (name, deadline) in enumerate(tiers)
            ]
        )
    ).alias("__t")
    return counts.select(*keys, "total", "correct", rows).select(*keys, "__t.tier", "__t.deadline_ms", "total", "correct", "__t.on_time", "__t.success_at_slo")


def tier_counts(
    df: DataFrame,
    keys: Sequence[str],
    tiers: Sequence[tuple[str, float]] = TIERS,
    latency: str = "latency_ms",
    correct: str = "task_correct",
    valid: str = "json_valid",
) -> DataFrame:
    """Counters per key and tier. All tiers come from one pass over the rows; the
    tier rows are made after aggregation."""
    counts = df.groupBy(*keys).agg(*_tier_aggs(tiers, latency, correct, valid))
    return _stack_tiers(counts, keys, tiers)


def tier_counts_with_total(
    df: DataFrame,
    model: str,
    task: str,
    tiers: Sequence[tuple[str, float]] = TIERS,
    latency: str = "latency_ms",
    correct: str = "task_correct",
    valid: str = "json_valid",
    total_label: str = "ALL",
) -> DataFrame:
    """Counters per (model, task) and per model, as grouping sets in one pass."""
    sets = df.groupingSets([[F.col(model), F.col(task)], [F.col(model)]], F.col(model), F.col(task)).agg(
        F.grouping(task).alias("__g"), *_tier_aggs(tiers, latency, correct, valid)
    )
    named = sets.withColumn(task, F.when(F.col("__g") == 1, F.lit(total_label)).otherwise(F.col(task)))
    return _stack_tiers(named, [model, task], tiers)


def with_percentages(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.col("total"))
    return counts.select(
        "*",
        (100.0 * F.col("correct") / n).alias("accuracy_pct"),
        (100.0 * F.col("on_time") / n).alias("on_time_pct"),
        (100.0 * F.col("success_at_slo") / n).alias("success_pct"),
    )


def weighted_accuracy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum counters over tasks, then divide."""
    n = F.greatest(F.lit(1), F.sum("total"))
    return counts.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        (100.0 * F.sum("correct") / n).alias("accuracy_pct"),
        (100.0 * F.sum("success_at_slo") / n).alias("success_pct"),
    )


def success_curve(
    df: DataFrame,
    by: Sequence[str],
    thresholds: Sequence[float],
    latency: str = "latency_ms",
    success: Column | None = None,
) -> DataFrame:
    """Share of rows that are on time (and successful, if given) at each threshold.

    Each row falls into one slot of the threshold list; the curve is summed from
    slot counts, so the rows are not multiplied by the thresholds.
    """
    cuts = sorted(float(t) for t in thresholds)
    slot = F.lit(0)
    for t in cuts:
        slot = slot + F.when(F.col(latency) <= t, F.lit(0)).otherwise(F.lit(1))
    good = F.lit(True) if success is None else success
    slots = df.groupBy(*by, slot.alias("__slot")).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(good).alias("__ok")
    )
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold_ms")) for i, t in enumerate(cuts)]))
    inside = F.col("__slot") <= F.col("__t.i")
    return (
        slots.withColumn("__t", rows)
        .groupBy(*by, F.col("__t.threshold_ms").alias("threshold_ms"))
        .agg(
            F.sum("__n").alias("n"),
            F.sum(F.when(inside, F.col("__n")).otherwise(0)).alias("on_time"),
            F.sum(F.when(inside, F.col("__ok")).otherwise(0)).alias("success"),
        )
        .withColumn("on_time_share", F.col("on_time") / F.col("n"))
        .withColumn("success_share", F.col("success") / F.col("n"))
    )


def success_curve_table(df: DataFrame, by: Sequence[str], thresholds: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Like ``success_curve`` with the thresholds in a table (a ``threshold_ms``
    column); only the distinct thresholds travel, as one array."""
    cuts = thresholds.agg(F.array_sort(F.collect_set(F.col("threshold_ms").cast("double"))).alias("cuts"))
    tagged = attach(df.select(*by, latency), cuts, [])
    # A row without latency is never on time: its slot lies past the last threshold.
    slot = F.expr(f"if({latency} is null, size(cuts), size(filter(cuts, t -> t < {latency})))")
    slots = attach(tagged.groupBy(*by, slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n")), cuts, [])
    return (
        slots.select(*by, "__slot", "__n", F.posexplode("cuts").alias("__i", "threshold_ms"))
        .groupBy(*by, "threshold_ms")
        .agg(
            F.sum("__n").alias("n"),
            F.sum(F.when(F.col("__slot") <= F.col("__i"), F.col("__n")).otherwise(0)).alias("on_time"),
        )
        .withColumn("on_time_share", F.col("on_time") / F.col("n"))
    )


def rate(flag: Column) -> Column:
    """Share of rows with a true flag, over all rows."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def suite_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Validity rates, latency percentiles, success, retry / repair / candidate use."""
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_episodes"),
        rate(F.col("json_valid")).alias("json_valid_rate"),
        rate(F.col("schema_valid")).alias("schema_valid_rate"),
        F.avg("success_at_slo").alias("success_at_slo"),
        F.avg("retry_count").alias("avg_retry_count"),
        F.avg("repair_count").alias("avg_repair_count"),
        F.avg("candidate_count").alias("avg_candidate_count"),
        rate(F.col("retry_count") > 0).alias("retry_rate"),
        rate(F.col("repair_count") > 0).alias("repair_rate"),
        rate(F.col("candidate_count") > 1).alias("candidate_rate"),
    )
    cuts = {"p50_latency_ms": 0.50, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return attach(base, exact_quantiles(df, by, F.col("latency_ms"), cuts), by)


def metric_means(df: DataFrame, by: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """Long form: mean of each metric over the records that have it."""
    return (
        # The outer form keeps Spark from testing the map for emptiness first, which
        # would compute every score twice; absent metrics are dropped right after.
        df.select(*by, F.explode_outer(metrics).alias("metric", "__value"))
        .where(F.col("__value").isNotNull())
        .groupBy(*by, "metric")
        .agg(F.avg("__value").alias("mean"), F.count(F.lit(1)).alias("n"))
    )


def log_summary(df: DataFrame, source: str, rule: str = "linear") -> DataFrame:
    """Per source: size, latency percentiles, validity, mean time to first token,
    mean tokens. Columns may be text; what does not parse counts as missing."""
    num = lambda c: F.col(c).try_cast("double")
    base = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.avg(num("json_valid"))).alias("json_valid_pct"),
        F.avg(num("ttft_ms")).alias("mean_ttft_ms"),
        F.avg(num("tokens_out")).alias("mean_tokens_out"),
    )
    cuts = {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return attach(base, exact_quantiles(df, [source], num("latency_ms"), cuts, rule), [source])


def without_sentinels(df: DataFrame, by: Sequence[str], cutoff_ms: float = 1e5, budget_ms: float = 2000.0) -> DataFrame:
    """Latency figures leave out error sentinels; shares keep all rows below."""
    kept = F.when(F.col("latency_ms") < cutoff_ms, F.col("latency_ms"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(kept).alias("n_kept"),
        F.avg(kept).alias("avg_latency_ms"),
        (100.0 * F.count_if(kept <= budget_ms) / F.count(F.lit(1))).alias("on_time_pct"),
        (100.0 * F.count_if((F.col("latency_ms") <= budget_ms) & F.col("json_valid") & F.col("task_correct")) / F.count(F.lit(1))).alias("success_pct"),
    )
    cuts = {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return attach(base, exact_quantiles(df, by, kept, cuts, "index_n_clamped"), by)


def latency_histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between each group's smallest and largest value; the
    last bin is closed."""
    span = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    v, lo, hi = F.col(value), F.col("__lo"), F.col("__hi")
    slot = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    tagged = attach(df.where(v.isNotNull()).select(*by, value), span, by)
    return (
        tagged.groupBy(*by, "__lo", "__hi", slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *by,
            "bin",
            (lo + (hi - lo) * F.col("bin") / bins).alias("bin_start"),
            "n",
        )
    )


def tradeoff_by_mode(df: DataFrame, mode: str = "decode_mode") -> DataFrame:
    """p95 latency, success and faithfulness per decode mode."""
    base = df.groupBy(mode).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("success_at_slo").alias("success_at_slo"),
        F.avg("faithfulness").alias("faithfulness"),
    )
    return attach(base, exact_quantiles(df, [mode], F.col("latency_ms"), {"p95_latency_ms": 0.95}), [mode])


def load_summary(df: DataFrame, run: str, start: str, end: str) -> DataFrame:
    """Request count, effective rate over the run's wall time, tail latency, success."""
    base = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(end) - F.min(start)).alias("elapsed_s"),
        (100.0 * rate(F.col("success"))).alias("success_pct"),
        F.avg("ttft_ms").alias("mean_ttft_ms"),
    )
    base = base.withColumn("effective_rps", F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s")).otherwise(F.lit(0.0)))
    cuts = {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    return attach(base, exact_quantiles(df, [run], F.col("latency_ms"), cuts, "index_n_clamped"), [run])


def extrapolate_tiers(df: DataFrame) -> DataFrame:
    """Tier counters estimated from a summary row (count, accuracy, avg/p95/p99
    latency, measured shares at the first tier). Counters are cut to whole numbers."""
    n, acc = F.col("count"), F.col("accuracy")
    avg, p95, p99 = F.col("avg_latency_ms"), F.col("p95_latency_ms"), F.col("p99_latency_ms")

    def headroom(limit: float) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - p99 / limit)

    def clamp(pct: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))

    standard = (
        F.when(p95 <= 5000.0, 95.0 + 4.0 * headroom(5000.0))
        .when(avg <= 5000.0, 100.0 * F.least(F.lit(1.0), 5000.0 / F.greatest(F.lit(1.0), p95)) * 0.95)
        .otherwise(F.greatest(F.lit(0.0), 100.0 * (1.0 - (avg - 5000.0) / F.greatest(F.lit(1.0), p99 - 5000.0))) * 0.5)
    )
    batch = (
        F.when(p99 <= 30000.0, F.lit(99.5))
        .when(p95 <= 30000.0, 95.0 + 4.5 * headroom(30000.0))
        .otherwise(100.0 * F.least(F.lit(1.0), 30000.0 / F.greatest(F.lit(1.0), p99)) * 0.95)
    )
    est = df.withColumn("__standard", clamp(standard)).withColumn("__batch", clamp(batch))
    whole = lambda c: c.cast("bigint")

    def row(tier: str, on_time_pct: Column, success_pct: Column) -> Column:
        return F.struct(
            F.lit(tier).alias("tier"),
            n.alias("total"),
            whole(n * on_time_pct / 100.0).alias("on_time"),
            whole(n * acc).alias("correct"),
            whole(n * success_pct / 100.0).alias("success_at_slo"),
        )

    rows = F.array(
        row("interactive", F.col("latency_slo_pct"), F.col("success_at_slo_pct")),
        row("standard", F.col("__standard"), F.col("__standard") * acc),
        row("batch", F.col("__batch"), F.col("__batch") * acc),
    )
    keys = [c for c in ("model", "task") if c in df.columns]
    return est.select(*keys, F.explode(rows).alias("__t")).select(*keys, "__t.*")


def completion_matrix(df: DataFrame, model: str, task: str, tasks: Sequence[str], models: DataFrame | None = None) -> DataFrame:
    """Wide count per model x task with the number and share of tasks present. ``models``
    lists the models to expect (a column named as ``model``); those that never ran have
    zeros."""
    wide = df.groupBy(model).pivot(task, list(tasks)).agg(F.count(F.lit(1)))
    if models is not None:
        wide = models.select(model).distinct().join(wide, model, "left")
    done = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0)) > 0).cast("int") for t in tasks)
    return wide.select(
        model,
        *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(t) for t in tasks],
        done.alias("tasks_done"),
        (100.0 * done / len(tasks)).alias("complete_pct"),
    )


def completion_gaps(matrix: DataFrame, model: str, tasks: Sequence[str]) -> DataFrame:
    """(model, task) pairs of the matrix without any row."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"`{t}`").alias("n")) for t in tasks])).alias("__c")
    return matrix.select(model, cells).where("__c.n = 0").select(model, "__c.task")
