"""Early prediction of run outcomes: logistic regression for all folds of a
cross-validation at once.

The models of many folds share every pass over the rows: a pass evaluates each row under each
fold's weights and sums, per fold, the gradient and the curvature over the rows that the fold
trains on. Rows are merged by equal features before, and sums are partial in each task, so
one iteration shuffles one row per fold and task, and the number of passes depends neither on
the number of folds nor on that of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach

FEATURES = ("early_mean_50", "peak_step_k", "size_rel")

# Newton steps of a fit, the length that a step is cut to, and the penalty on the squared
# weights (not on the bias), which keeps them finite when the classes separate.
STEPS = 12
LONGEST_STEP = 8.0
PENALTY = 1e-3
# Folds that one sequence of passes fits; more are fitted block by block. The driver holds this
# many small systems of equations.
FOLDS_AT_ONCE = 4_096


def outcome_features(curves: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scaled features and the label (sustained or not) at run grain."""
    joined = curves.join(sizes.select("model", "size_b", "family"), "model", "left")
    return joined.select(
        "model",
        "task",
        F.coalesce("family", F.lit("unknown")).alias("family"),
        F.coalesce("early_mean_50", F.lit(0.0)).alias("early_mean_50"),
        (F.coalesce("peak_step", F.lit(0)) / 1000.0).alias("peak_step_k"),
        (F.coalesce("size_b", F.lit(5.0)) / 12.0).alias("size_rel"),
        (F.col("category") == "sustained").cast("double").alias("label"),
    )


def _merged(df: DataFrame, features: Sequence[str], label: str, fold: Column) -> DataFrame:
    """Rows with equal fold, features and label as one: ``__fold``, ``__x`` (with a last 1 for
    the bias), ``__y`` and ``__n``. Rows without a feature or label train nothing."""
    known = [*features, label]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in known))
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    return rows.groupBy(fold.alias("__fold"), x.alias("__x"), F.col(label).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__n"))


def _sums(rows: DataFrame, models: dict[int, np.ndarray], width: int) -> DataFrame:
    """Per fold: rows trained on, their positives, gradient ``g0..`` and curvature ``h0_0..``
    at the fold's weights. ``rows`` has ``__own``, the fold that holds some of the row out,
    and ``__held``, how many of its ``__n`` copies that are."""
    state = json.dumps([{"f": f, "w": w.tolist()} for f, w in models.items()])
    weights = F.from_json(F.lit(state), "array<struct<f:int,w:array<double>>>")
    each = rows.select("__x", "__y", "__n", "__own", "__held", F.explode(weights).alias("__m"))
    z = sum((F.col("__x")[i] * F.col("__m.w")[i] for i in range(width)), F.lit(0.0))
    n = F.col("__n") - F.when(F.col("__own") == F.col("__m.f"), F.col("__held")).otherwise(F.lit(0))
    each = each.select(F.col("__m.f").alias("f"), "__x", "__y", n.cast("double").alias("n"), (1 / (1 + F.exp(-z))).alias("p"))
    x = [F.col("__x")[i] for i in range(width)]
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("__y")).alias("ones")]
    sums += [F.sum(F.col("n") * (F.col("p") - F.col("__y")) * x[i]).alias(f"g{i}") for i in range(width)]
    curve = F.col("n") * F.col("p") * (1 - F.col("p"))
    sums += [F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(width) for j in range(i + 1)]
    return each.groupBy("f").agg(*sums)


def _newton(found: Sequence, models: dict[int, np.ndarray], width: int, penalty: float) -> dict[int, np.ndarray]:
    """Weights after one Newton step on the mean log loss plus penalty, for all folds."""
    out = dict(models)
    for r in found:
        if not r["n"] or r["ones"] in (0, r["n"]):
            continue
        w = models[r["f"]]
        gradient = np.array([r[f"g{i}"] for i in range(width)]) / r["n"]
        curvature = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(width)] for i in range(width)]) / r["n"]
        lean = np.full(width, penalty)
        lean[-1] = 0.0
        try:
            step = np.linalg.solve(curvature + np.diag(lean), gradient + lean * w)
        except np.linalg.LinAlgError:  # nothing left to tell the bias from
            continue
        out[r["f"]] = w - step * min(1.0, LONGEST_STEP / max(float(np.sqrt(step @ step)), 1e-300))
    return out


def fit_folds(rows: DataFrame, folds: int, features: Sequence[str] = FEATURES, steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """One model per fold 0 to ``folds`` - 1: ``fold``, ``weights`` (the bias last), ``n`` and
    ``ones``, the rows and positives trained on. ``rows`` are as ``_sums`` reads them and are
    read once per step, so they should be stored. Without rows to train on, weights are NULL;
    with one class only they are 0 and the class decides, see ``predicted``."""
    spark, width, done = rows.sparkSession, len(features) + 1, []
    for first in range(0, folds, FOLDS_AT_ONCE):
        models = {f: np.zeros(width) for f in range(first, min(folds, first + FOLDS_AT_ONCE))}
        sizes: dict[int, tuple[int, int]] = {}
        for _ in range(steps):
            found = _sums(rows, models, width).collect()  # a row per fold of the block
            sizes = sizes or {r["f"]: (int(r["n"]), int(r["ones"])) for r in found}
            models = _newton(found, models, width, penalty)
        done += [(f, [float(v) for v in w] if sizes.get(f, (0, 0))[0] else None, *sizes.get(f, (0, 0))) for f, w in models.items()]
    return spark.createDataFrame(done, "fold int, weights array<double>, n bigint, ones bigint")


def predicted(df: DataFrame, models: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """``df`` with ``probability`` and ``prediction`` (1.0 from one half on) under the model of
    its column ``fold``. Models of one class predict it; without a model both are NULL."""
    x = [F.col(c).cast("double") for c in features]
    z = sum((F.col("weights")[i] * c for i, c in enumerate(x)), F.col("weights")[len(x)])
    share = F.when(F.col("n") == F.col("ones"), F.lit(1.0)).when(F.col("ones") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))
    held = df.join(models.withColumnRenamed("fold", fold), fold, "left")
    held = held.withColumn("probability", F.when(F.col("weights").isNotNull() & z.isNotNull(), share))
    return held.select(*df.columns, "probability", (F.col("probability") >= 0.5).cast("double").alias("prediction"))


def _stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: every step reads the rows again."""
    from sloframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows``, stored, with dense numbers from 0, and how many there are: a task numbers its
    own rows, after those of the tasks before it."""
    at = F.monotonically_increasing_id()
    kept = _stored(rows.withColumn("__part", F.shiftright(at, 33)).withColumn("__place", at.bitwiseAND((1 << 33) - 1)))
    begin, total = {}, 0
    for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # a row per task
        begin[r["__part"]], total = total, total + r["n"]
    offset = F.from_json(F.lit(json.dumps(begin)), "map<string,bigint>")[F.col("__part").cast("string")]
    return kept.withColumn(name, (offset + F.col("__place")).cast("int")).drop("__part", "__place"), total


def in_sample(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """Predictions of one model fitted on all rows."""
    return predicted(df.withColumn("__fold", F.lit(0)), fitted(df, features, label), "__fold", features).drop("__fold")


def fitted(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """The model of all rows as ``fit_folds`` returns it, with fold 0."""
    merged = _merged(df, features, label, F.lit(None).cast("int"))
    return fit_folds(_stored(merged.withColumn("__own", F.lit(-1)).withColumn("__held", F.lit(0))), 1, features)


def leave_group_out(df: DataFrame, group: str, features: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """Predictions for each group by a model of all other groups.

    A training side with one class predicts that class. A group whose training side is
    empty, as when there is only one, has no prediction. A NULL group is a group.
    """
    names, n = _numbered(df.select(F.col(group).alias("__name")).distinct(), "__fold")
    rows = df.join(names, df[group].eqNullSafe(names["__name"])).drop("__name")
    merged = _merged(rows, features, label, F.col("__fold"))
    models = fit_folds(_stored(merged.withColumn("__own", F.col("__fold")).withColumn("__held", F.col("__n"))), n, features)
    return predicted(rows, models, "__fold", features).select(*df.columns, "probability", "prediction")


def leave_fold_out(df: DataFrame, key: Sequence[str], folds: int = 10, features: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """Cross-validation over folds dealt by the MD5 of the key columns."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    rows = df.withColumn("__fold", F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int"))
    merged = _merged(rows, features, label, F.col("__fold"))
    models = fit_folds(_stored(merged.withColumn("__own", F.col("__fold")).withColumn("__held", F.col("__n"))), folds, features)
    return predicted(rows, models, "__fold", features).drop("__fold")


def leave_one_out(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "label") -> DataFrame:
    """Each row predicted by the model of all other rows, exactly.

    Rows with equal features and label leave the same rows behind, so there is one fold per
    distinct row, which holds out one of its copies; the work is the square of the distinct
    rows, whatever their copies. Round the features beforehand to bound it.
    """
    distinct, n = _numbered(_merged(df, features, label, F.lit(None).cast("int")).drop("__fold"), "__own")
    models = fit_folds(distinct.withColumn("__held", F.lit(1)), n, features)
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    keyed = df.withColumn("__x", x).withColumn("__y", F.col(label).cast("double"))
    keyed = keyed.join(distinct.select("__x", "__y", "__own"), ["__x", "__y"], "left")
    return predicted(keyed, models, "__own", features).select(*df.columns, "probability", "prediction")


def group_accuracy(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy per group, per-group list size and correct count."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("correct"), F.avg(hit).alias("accuracy"))


def prediction_lists(predictions: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Accuracy and the list of predictions per group. The predictions are at run
    grain and the list holds one entry per run of one model."""
    entry = F.struct(F.col(item), F.col("prediction").cast("int").alias("predicted"), F.col("label").cast("int").alias("actual"))
    return attach(
        group_accuracy(predictions, by), predictions.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("predictions")), by
    )


def majority_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    n, ones = F.count(F.lit(1)), F.sum(label)
    return df.agg(n.alias("n"), ones.cast("bigint").alias("n_sustained"), (F.greatest(ones, n - ones) / n).alias("baseline_accuracy"))


def stop_rule(df: DataFrame, signal: str, label: str = "label", limit: float = 0.10, holds_above: float = 0.8) -> DataFrame:
    """Outcome counts below and at or above the early-stop limit, and whether the
    rule (below the limit means failure) holds."""
    side = F.when(F.col(signal) < limit, "below").otherwise("above")
    out = df.groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("sustained"), F.avg(label).alias("sustained_ratio")
    )
    failing = 1.0 - F.col("sustained_ratio")
    return out.withColumn("not_sustained", F.col("n") - F.col("sustained")).withColumn(
        "rule_holds", F.when(F.col("side") == "below", failing > holds_above)
    )
