"""Before / after comparison of two groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.functions.stats import cohens_h, two_proportion_z, two_sided_p, wilson
from sloframe.operators.ordered import attach, running_totals


def proportion_test(df: DataFrame, by: Sequence[str], arm: str, treated: object, success: Column, alpha: float = 0.01, comparisons: int = 1) -> DataFrame:
    """Two-sided z-test of a success share between the two arms of each group, with
    effect size, score interval of the treated share and the corrected level. What a
    missing arm would be needed for is NULL."""
    hot = F.col(arm) == treated
    ok = F.coalesce(success, F.lit(False))
    sums = df.groupBy(*by).agg(
        F.count_if(hot).cast("double").alias("n1"), F.count_if(hot & ok).cast("double").alias("s1"),
        F.count_if(~hot).cast("double").alias("n0"), F.count_if(~hot & ok).cast("double").alias("s0"),
    )
    n1, s1, n0, s0 = (F.col(c) for c in ("n1", "s1", "n0", "s0"))
    z = two_proportion_z(s1, n1, s0, n0)
    out = sums.select(
        *by, F.try_divide(s1, n1).alias("p1"), F.try_divide(s0, n0).alias("p0"), z.alias("z"), two_sided_p(z).alias("p_value"),
        cohens_h(F.try_divide(s1, n1), F.try_divide(s0, n0)).alias("cohens_h"), wilson(s1, n1).alias("__w"),
    )
    level = alpha / comparisons
    return out.select("*", F.col("__w.lower").alias("p1_lower"), F.col("__w.upper").alias("p1_upper"), (F.col("p_value") < level).alias("significant")).drop("__w")


def ks_distance(df: DataFrame, by: Sequence[str], value: str, arm: str, treated: object, bins: int = 128) -> DataFrame:
    """Largest gap between the two empirical distribution functions of each group.

    Values are counted before any ordering. Approximate quantiles of a group's
    distinct values cut it into bins of about equal size whatever the outliers, and
    running counts go bin by bin, so no task sorts a whole group.
    """
    by = list(by)
    hot = (F.col(arm) == treated).cast("bigint")
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__v"))
        .agg(F.sum(hot).alias("__a"), F.sum(1 - hot).alias("__b"))
    )
    cuts = [i / bins for i in range(1, bins)]
    facts = cells.groupBy(*by).agg(
        F.percentile_approx("__v", cuts, 10_000).alias("__cuts"), F.sum("__a").alias("__na"), F.sum("__b").alias("__nb")
    )
    bin_ = F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
    run = running_totals(attach(cells, facts, by), by, [bin_], [F.col("__v")], {"__ca": F.col("__a"), "__cb": F.col("__b")})
    gap = F.abs(F.try_divide("__ca", "__na") - F.try_divide("__cb", "__nb"))
    return run.groupBy(*by).agg(F.max("__na").alias("n1"), F.max("__nb").alias("n0"), F.max(gap).alias("ks"))
