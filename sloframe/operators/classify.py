"""Label metrics from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach


def confusion(df: DataFrame, by: Sequence[str], true: str, pred: str) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(df: DataFrame, by: Sequence[str], true: str, pred: str, eps: float = 0.0, missing: object = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per label seen on either side. Rows without a
    true label are left out, and so are rows without a prediction unless ``missing`` names
    the label that they get."""
    if missing is not None:
        df = df.withColumn(pred, F.coalesce(pred, F.lit(missing)))
    cells = confusion(df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()), by, true, pred)
    hit, n = F.col("true") == F.col("pred"), F.col("n")
    sides = F.when(hit, F.array(F.struct(F.col("true").alias("label"), n.alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn")))).otherwise(
        F.array(
            F.struct(F.col("true").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), n.alias("fn")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), n.alias("fp"), F.lit(0).cast("bigint").alias("fn")),
        )
    )
    sums = (
        cells.select(*by, F.explode(sides).alias("__s"))
        .groupBy(*by, F.col("__s.label").alias("label"))
        .agg(F.sum("__s.tp").alias("tp"), F.sum("__s.fp").alias("fp"), F.sum("__s.fn").alias("fn"))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(a: Column, b: Column) -> Column:
        return a / (b + eps) if eps else F.when(b > 0, a / b).otherwise(F.lit(0.0))

    with_pr = sums.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return with_pr.withColumn("f1", share(2 * p * r, p + r))


def macro_f1(df: DataFrame, by: Sequence[str], true: str, pred: str, eps: float = 0.0, missing: object = None) -> DataFrame:
    return label_scores(df, by, true, pred, eps, missing).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labels"), F.avg("f1").alias("macro_f1")
    )


def unscored(df: DataFrame, by: Sequence[str], true: str, pred: str) -> DataFrame:
    """Rows per group that label metrics leave out for want of a label or prediction."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(true).isNull() | F.col(pred).isNull()).alias("n_unscored"))


def out_of_scope(df: DataFrame, by: Sequence[str], true: str, pred: str, label: str) -> DataFrame:
    """Macro-F1 of the labels in scope, and accuracy on rows whose true label is ``label``."""
    known = df.where(F.col(pred).isNotNull())
    inside = macro_f1(known.where(F.col(true) != label), by, true, pred)
    outside = accuracy(known.where(F.col(true) == label), by, true, pred, "oos_accuracy").withColumnRenamed("n", "n_oos")
    return attach(inside, outside, by)


def accuracy(df: DataFrame, by: Sequence[str], true: str, pred: str, name: str = "accuracy") -> DataFrame:
    same = F.coalesce(F.col(true) == F.col(pred), F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias(name))


def cohen_kappa(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Agreement beyond chance; rows with an empty label are left out."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    cells = confusion(df.where(present(a) & present(b)), by, a, b)
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("ca"), F.lit(0).cast("bigint").alias("cb")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("ca"), F.col("n").alias("cb")),
    )
    chance = (
        cells.select(*by, F.explode(sides).alias("__s"))
        .groupBy(*by, F.col("__s.label").alias("label"))
        .agg(F.sum("__s.ca").alias("ca"), F.sum("__s.cb").alias("cb"))
        .groupBy(*by)
        .agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("__cross"))
    )
    agree = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("agree")
    )
    n = F.col("n").cast("double")
    p0, pe = F.col("agree") / n, F.col("__cross") / (n * n)
    out = attach(agree, chance, by)
    return out.select(*by, "n", p0.alias("observed"), pe.alias("expected"), F.when(pe == 1, F.lit(1.0)).otherwise((p0 - pe) / (1 - pe)).alias("kappa"))


def label_domain(df: DataFrame, by: Sequence[str], label: str, domain: DataFrame, domain_label: str) -> DataFrame:
    """Share of non-null labels that belong to the label set."""
    known = domain.select(F.col(domain_label).alias("__known")).distinct()
    seen = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    joined = seen.join(known, seen["__label"] == known["__known"], "left")
    inside = F.sum(F.when(F.col("__known").isNotNull(), F.col("__n")).otherwise(0))
    return joined.groupBy(*by).agg(
        F.sum("__n").alias("n"), inside.alias("matched"), (inside / F.sum("__n")).alias("match_rate"), (inside == F.sum("__n")).alias("accepted")
    )
