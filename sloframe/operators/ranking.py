"""Ranks, rank agreement and resampled intervals at model grain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloframe.functions.stats import hash32, pearson, spearman_p
from sloframe.operators.ordered import attach


def average_rank(value: str, partition: Sequence[str], descending: bool = True) -> Column:
    """Rank 1 = best; ties share the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    first = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return first + (ties - 1) / 2.0


def ordinal_rank(value: str, key: str, partition: Sequence[str], descending: bool = True) -> Column:
    """Places 1, 2, 3 ...; ties go by key."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.row_number().over(Window.partitionBy(*partition).orderBy(order, F.col(key).asc()))


def leaderboard(rows: DataFrame, tier: str = "tier", model: str = "model", a: str = "accuracy_pct", b: str = "success_pct") -> DataFrame:
    """Average and ordinal ranks of both measures per tier, with their difference."""
    ranked = rows.select(
        "*",
        average_rank(a, [tier]).alias("accuracy_rank"),
        average_rank(b, [tier]).alias("slo_rank"),
        ordinal_rank(a, model, [tier]).alias("accuracy_place"),
        ordinal_rank(b, model, [tier]).alias("slo_place"),
    )
    return ranked.withColumn("rank_delta", F.col("accuracy_rank") - F.col("slo_rank"))


def inversions(board: DataFrame, tier: str = "tier", more_than: float = 2.0) -> DataFrame:
    return board.groupBy(tier).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(F.abs(F.col("rank_delta")) > more_than).alias("rank_inversions"),
        F.max(F.abs(F.col("rank_delta"))).alias("max_delta"),
    )


def _rank_sums(by: Sequence[str], ranked: DataFrame) -> DataFrame:
    ra, rb = F.col("__ra"), F.col("__rb")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ra).alias("sa"),
        F.sum(rb).alias("sb"),
        F.sum(ra * ra).alias("saa"),
        F.sum(rb * rb).alias("sbb"),
        F.sum(ra * rb).alias("sab"),
        F.sum((ra - rb) * (ra - rb)).alias("sdd"),
    )


def spearman(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation, tie-correct (``rho``) and by squared differences
    (``rho_d2``), with p-values. Ranks are multiples of 1/2, so the sums are exact."""
    ranked = rows.withColumn("__ra", average_rank(a, by)).withColumn("__rb", average_rank(b, by))
    s = _rank_sums(by, ranked)
    n = F.col("n").cast("double")
    rho = pearson(n, F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sab"))
    d2 = F.when(n >= 3, 1.0 - 6.0 * F.col("sdd") / (n * (n * n - 1.0))).otherwise(F.lit(0.0))
    out = s.select(*by, "n", rho.alias("rho"), d2.alias("rho_d2"))
    return out.select(
        "*",
        spearman_p(F.col("rho"), F.col("n")).alias("p_value"),
        spearman_p(F.col("rho_d2"), F.col("n"), small_sample=True).alias("p_value_small_sample"),
    )


def bootstrap_spearman(
    rows: DataFrame, by: Sequence[str], key: str, a: str, b: str, resamples: int = 1000, seed: int = 42
) -> DataFrame:
    """Percentile interval of the rank correlation over resamples with replacement.

    ``rows`` is at model grain (one row per model and group). Draw j of resample r
    takes the model whose place is md5(seed|r|j) mod n, so runs repeat exactly.
    Ranks inside a resample follow from counts per drawn model, not from a sort of
    the draws: a model drawn c times is c tied entries.
    """
    by = list(by)
    placed = rows.withColumn("__j", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).withColumn(
        "__n", F.count(F.lit(1)).over(Window.partitionBy(*by))
    )
    draws = (
        placed.select(*by, "__j", "__n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("__r"))
        .repartition(*by, "__r")
        .withColumn("__pick", F.pmod(hash32(F.concat_ws("|", F.lit(seed), F.col("__r"), F.col("__j"))), F.col("__n")))
        .groupBy(*by, "__r", F.col("__pick").alias("__j"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    values = placed.select(*by, "__j", F.col(a).alias("__a"), F.col(b).alias("__b"))
    drawn = attach(draws, values, [*by, "__j"])

    def tied_rank(value: str) -> Column:
        above = Window.partitionBy(*by, "__r").orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(*by, "__r", value)
        upto = F.sum("__c").over(above)
        return upto - (F.sum("__c").over(same) - 1) / 2.0

    ranked = drawn.withColumn("__ra", tied_rank("__a")).withColumn("__rb", tied_rank("__b"))
    c, ra, rb = F.col("__c"), F.col("__ra"), F.col("__rb")
    per = (
        ranked.groupBy(*by, "__r")
        .agg(
            F.sum(c).cast("double").alias("n"),
            F.sum(c * ra).alias("sa"),
            F.sum(c * rb).alias("sb"),
            F.sum(c * ra * ra).alias("saa"),
            F.sum(c * rb * rb).alias("sbb"),
            F.sum(c * ra * rb).alias("sab"),
        )
        .select(*by, pearson(F.col("n"), F.col("sa"), F.col("sb"), F.col("saa"), F.col("sbb"), F.col("sab")).alias("rho"))
    )
    sorted_ = F.array_sort(F.collect_list("rho"))  # one value per resample
    lo, hi = int(0.025 * resamples), min(int(0.975 * resamples), resamples - 1)
    ci = per.groupBy(*by).agg(sorted_.alias("__s")).select(*by, F.col("__s")[lo].alias("ci_lower"), F.col("__s")[hi].alias("ci_upper"))
    return attach(spearman(rows, by, a, b), ci, by).select(*by, "n", "rho", "ci_lower", "ci_upper", "p_value")


# Cumulative Poisson(1) probabilities in units of 2^-16: a 16-bit draw has the
# weight k when k of these limits lie at or below it.
POISSON_CUTS = tuple(
    round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)
)


def bootstrap_mean(df: DataFrame, by: Sequence[str], key: Column, value: str, resamples: int = 200, alpha: float = 0.05, seed: int = 17) -> DataFrame:
    """Percentile interval of the mean in one pass over any number of rows.

    Each row gets an independent Poisson(1) weight per resample. One md5 serves
    eight resamples (16 bits each), and weights are summed map-side, so the
    shuffle carries one row per group, task and resample.
    """
    groups = (resamples + 7) // 8
    v = F.col(value).cast("double")
    digests = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), g.cast("string"))),
    )
    exploded = df.where(v.isNotNull()).select(*by, v.alias("__v"), F.posexplode(digests).alias("__g", "__h"))
    weights = []
    for i in range(8):
        bits = F.conv(F.substring("__h", 1 + 4 * i, 4), 16, 10).cast("int")
        w = sum((bits >= cut).cast("int") for cut in POISSON_CUTS)
        weights.append(w)
    sums = exploded.groupBy(*by, "__g").agg(
        F.sum("__v").alias("__s"),
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(w).alias(f"__w{i}") for i, w in enumerate(weights)],
        *[F.sum(w * F.col("__v")).alias(f"__x{i}") for i, w in enumerate(weights)],
    )
    per = sums.select(
        *by,
        "__g",
        "__s",
        "__n",
        F.posexplode(F.array(*[F.when(F.col(f"__w{i}") > 0, F.col(f"__x{i}") / F.col(f"__w{i}")) for i in range(8)])).alias("__i", "__m"),
    ).where((F.col("__g") * 8 + F.col("__i") < resamples) & F.col("__m").isNotNull())
    out = per.groupBy(*by).agg(
        F.max(F.when(F.col("__g") == 0, F.col("__n"))).alias("n"),
        F.max(F.when(F.col("__g") == 0, F.col("__s") / F.col("__n"))).alias("mean"),
        F.array_sort(F.collect_list("__m")).alias("__means"),  # one value per resample
    )
    at = lambda q: F.element_at("__means", (F.floor(F.lit(q) * (F.size("__means") - 1)) + 1).cast("int"))
    return out.select(*by, "n", "mean", at(alpha / 2).alias("ci_lower"), at(1 - alpha / 2).alias("ci_upper"))
