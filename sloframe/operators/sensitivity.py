"""How classes change when their thresholds move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.operators.curves import (
    CATASTROPHIC_DELTA, ROBUST_DELTA, SUSTAINED_FINAL, TRANSIENT_PEAK, classify_curve, profile,
)

# Sweep points.
SUSTAINED_SWEEP = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
TRANSIENT_SWEEP = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
JOINT_SUSTAINED = (0.50, 0.55, 0.60, 0.65, 0.70)
JOINT_TRANSIENT = (0.20, 0.25, 0.30, 0.35, 0.40)
OFFSETS = (-0.05, -0.03, 0.0, 0.03, 0.05)


def _grid(points: Sequence[tuple[float, float]], a: str, b: str):
    """Grid points as an array literal: curves are exploded over it, never joined."""
    return F.explode(F.array(*[F.struct(F.lit(float(x)).alias(a), F.lit(float(y)).alias(b)) for x, y in points]))


def curve_sweep(curves: DataFrame, points: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Class counts and changes from the default per (sustained, transient) point.

    Without ``points``: both one-way sweeps and the joint grid, duplicates removed.
    """
    if points is None:
        joint = {(s, t) for s in JOINT_SUSTAINED for t in JOINT_TRANSIENT}
        one_way = {(s, TRANSIENT_PEAK) for s in SUSTAINED_SWEEP} | {(SUSTAINED_FINAL, t) for t in TRANSIENT_SWEEP}
        points = sorted(joint | one_way)
    g = curves.select("peak", "final", _grid(points, "sustained", "transient").alias("g"))
    now = classify_curve(F.col("peak"), F.col("final"), F.col("g.sustained"), F.col("g.transient"))
    was = classify_curve(F.col("peak"), F.col("final"))
    rows = g.select(F.col("g.sustained").alias("sustained_at"), F.col("g.transient").alias("transient_at"), now.alias("now"), was.alias("was"))
    changes = F.count_if(F.col("now") != F.col("was"))
    n = F.count(F.lit(1))
    return rows.groupBy("sustained_at", "transient_at").agg(
        n.alias("n"),
        *[F.count_if(F.col("now") == c).alias(c) for c in ("sustained", "transient", "flat")],
        changes.alias("changes"),
        (100.0 * (n - changes) / n).alias("pct_stable"),
    )


def forgetting_sweep(matrix: DataFrame, offsets: Sequence[float] = OFFSETS) -> DataFrame:
    points = [(ROBUST_DELTA + a, CATASTROPHIC_DELTA + b) for a in offsets for b in offsets]
    g = matrix.select("delta", _grid(points, "robust", "catastrophic").alias("g"))
    now = profile(F.col("delta"), F.col("g.robust"), F.col("g.catastrophic"))
    rows = g.select(F.round("g.robust", 3).alias("robust_at"), F.round("g.catastrophic", 3).alias("catastrophic_at"), now.alias("now"), profile(F.col("delta")).alias("was"))
    return rows.groupBy("robust_at", "catastrophic_at").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("now") == c).alias(c) for c in ("robust", "selective", "catastrophic")],
        F.count_if(F.col("now") != F.col("was")).alias("changes"),
    )


def stable_curves(curves: DataFrame, key: Sequence[str], delta: float = 0.10) -> DataFrame:
    """Curves whose class stays the same at -delta, 0 and +delta of the sustained limit."""
    classes = F.array_distinct(F.array(*[classify_curve(F.col("peak"), F.col("final"), SUSTAINED_FINAL + x) for x in (-delta, 0.0, delta)]))
    rows = curves.select(*key, (F.size(classes) == 1).alias("stable"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_curves"), F.count_if("stable").alias("n_stable"), (100.0 * F.count_if("stable") / F.count(F.lit(1))).alias("pct_stable")
    )
