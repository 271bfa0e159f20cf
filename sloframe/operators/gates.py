"""Criteria checks and tier gates over summary metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach, exact_quantiles

Threshold = tuple[str, str, str, float]  # family, metric, ">=" or "<=", limit


def meets(value: Column, op: str, limit: Column | float) -> Column:
    """Comparison in which a missing metric fails."""
    passed = value <= limit if op == "<=" else value >= limit
    return F.coalesce(passed, F.lit(False))


def episode_gate(metrics: dict[str, Column], rules: Sequence[tuple[str | None, str, str, float]], task: Column, latency: Column, budget_ms: float) -> Column:
    """Struct(quality, on_time, success). A rule is (task or None for all, metric,
    operator, limit) and applies to rows of its task only."""
    quality = F.lit(True)
    for only, metric, op, limit in rules:
        passed = meets(metrics[metric], op, limit)
        quality = quality & (passed if only is None else (task != only) | passed)
    on_time = F.coalesce(latency <= budget_ms, F.lit(False))
    return F.struct(quality.alias("quality"), on_time.alias("on_time"), (quality & on_time).cast("double").alias("success_at_slo"))


def criteria_check(df: DataFrame, by: Sequence[str], thresholds: Sequence[Threshold], p95_max: float | None = None, p99_max: float | None = None,
                   on_time_ms: float | None = None, success_min: float | None = None) -> DataFrame:
    """Long result (metric, value, limit, pass): share of rows that meet each
    threshold, tail latency against its limits, on-time rate, mean success.

    Thresholds whose column is absent are skipped. One aggregation serves all rows.
    """
    by = list(by)
    used = [t for t in thresholds if t[1] in df.columns]
    aggs = [F.avg(F.when(meets(F.col(m).cast("double"), op, limit), 1.0).otherwise(0.0)).alias(f"s{i}") for i, (_, m, op, limit) in enumerate(used)]
    lines = [(f"{m}_pass_share", f"s{i}", ">=", None) for i, (_, m, _, _) in enumerate(used)]
    cuts: dict[str, float] = {}
    if "latency_ms" in df.columns:
        if p95_max is not None:
            cuts["p95_ms"] = 0.95
        if p99_max is not None:
            cuts["p99_ms"] = 0.99
        if on_time_ms is not None:
            aggs.append(F.avg(F.when(F.col("latency_ms") <= on_time_ms, 1.0).otherwise(0.0)).alias("on_time_rate"))
            lines.append(("on_time_rate", "on_time_rate", ">=", None))
    if "success_at_slo" in df.columns:
        aggs.append(F.avg("success_at_slo").alias("success"))
        lines.append(("success_at_slo_rate", "success", ">=", success_min))
    facts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *aggs)
    if cuts:
        facts = attach(facts, exact_quantiles(df, by, F.col("latency_ms"), cuts), by)
        lines += [(name, name, "<=", p95_max if name == "p95_ms" else p99_max) for name in cuts]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("metric"),
                    F.col(column).alias("value"),
                    F.lit(limit).cast("double").alias("limit"),
                    (meets(F.col(column), op, limit) if limit is not None else F.lit(None).cast("boolean")).alias("passed"),
                )
                for name, column, op, limit in lines
            ]
        )
    ).alias("r")
    return facts.select(*by, rows).select(*by, "r.*")


# Gates per tier as (metric, operator, limit); each tier also needs
# the tier before it.
TIER_GATES: tuple[tuple[str, tuple[tuple[str, str, float], ...]], ...] = (
    ("bronze", (("json_valid_rate", ">=", 0.99), ("schema_valid_rate", ">=", 0.98), ("p95_latency_ms", "<=", 1200.0))),
    ("silver", (("intent_macro_f1", ">=", 0.85), ("answer_f1", ">=", 0.75), ("faithfulness", ">=", 0.80), ("disagreement", "<=", 0.10))),
    ("gold", (("tool_success_rate", ">=", 0.90), ("success_at_slo", ">=", 0.75))),
)

# Tail limits (p95, p99 in ms) per deadline tier for certification.
CERTIFICATION_LIMITS = {"interactive": (2000.0, 3000.0), "standard": (5000.0, 8000.0), "batch": (30000.0, 45000.0)}


def certification_gates(tier: str):
    """Gates of the three certification levels at one deadline tier."""
    p95, p99 = CERTIFICATION_LIMITS[tier]
    return (
        ("bronze", (("json_valid_rate", ">=", 0.95), ("schema_valid_rate", ">=", 0.90), ("p95_latency_ms", "<=", p95), ("success_at_slo", ">=", 0.70))),
        ("silver", (("faithfulness", ">=", 0.80), ("disagreement", "<=", 0.15))),
        ("gold", (("json_valid_rate", ">=", 0.99), ("success_at_slo", ">=", 0.90), ("faithfulness", ">=", 0.85), ("disagreement", "<=", 0.10),
                  ("function_calling", ">=", 0.85), ("routing", ">=", 0.90), ("p99_latency_ms", "<=", p99))),
    )


def _passed(summary: DataFrame, gates) -> dict[str, Column]:
    """Per tier whether all of its gates and those of the tiers before it are passed."""
    out, before = {}, F.lit(True)
    for name, rules in gates:
        for metric, op, limit in rules:
            value = F.col(metric).cast("double") if metric in summary.columns else F.lit(None).cast("double")
            before = before & meets(value, op, limit)
        out[name] = before
    return out


def tier_gates(summary: DataFrame, gates=TIER_GATES) -> DataFrame:
    """Boolean column per tier and the highest tier reached. A gate on a metric the
    summary lacks, or whose value is NULL, fails."""
    passed = _passed(summary, gates)
    out = summary.withColumns({f"tier_{name}": ok for name, ok in passed.items()})
    highest = F.lit("none")
    for name in passed:
        highest = F.when(F.col(f"tier_{name}"), F.lit(name)).otherwise(highest)
    return out.withColumn("highest_tier", highest)


def certification(summary: DataFrame, by: Sequence[str], gates=certification_gates, tiers: Sequence[str] = tuple(CERTIFICATION_LIMITS)) -> DataFrame:
    """The levels reached at every deadline tier: one row per summary row and ``slo_tier``,
    from one reading of the summary."""
    cells = []
    for tier in tiers:
        passed = _passed(summary, gates(tier))
        highest = F.lit("none")
        for name, ok in passed.items():
            highest = F.when(ok, F.lit(name)).otherwise(highest)
        cells.append(F.struct(F.lit(tier).alias("slo_tier"), *[ok.alias(f"tier_{name}") for name, ok in passed.items()], highest.alias("highest_tier")))
    return summary.select(*by, F.explode(F.array(*cells)).alias("__c")).select(*by, "__c.*")


def composite_score(summary: DataFrame, weights: dict[str, float], lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of metrics in [0, 1]; missing metrics count as 0 and for
    ``lower_is_better`` ones 1 - value enters."""
    total = F.lit(0.0)
    for metric, weight in weights.items():
        value = F.col(metric).cast("double") if metric in summary.columns else F.lit(None).cast("double")
        good = 1.0 - value if metric in lower_is_better else value
        total = total + weight * F.coalesce(good, F.lit(0.0))
    return summary.withColumn("composite_score", total)


def calibration_error(df: DataFrame, by: Sequence[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal confidence bins in [0, 1]."""
    slot = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    cells = df.where(F.col(confidence).isNotNull()).groupBy(*by, slot.alias("__b")).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(confidence).alias("__c"), F.avg(F.col(correct).cast("double")).alias("__a")
    )
    return cells.groupBy(*by).agg(
        F.sum("__n").alias("n"), (F.sum(F.col("__n") * F.abs(F.col("__a") - F.col("__c"))) / F.sum("__n")).alias("calibration_error")
    )
