"""Bag-of-words overlap for texts of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.functions.text import bag_f1_from_counts, qa_normalize, tokens


def qa_scores(df: DataFrame, keys: Sequence[str], pred: Column, gold: Column) -> DataFrame:
    """Exact match and bag-of-tokens F1 of normalised texts, per key.

    Words of both sides are counted per (key, word) across tasks; the quadratic
    word-by-word comparison inside a row is never made.
    """
    texts = df.select(*keys, qa_normalize(pred).alias("__p"), qa_normalize(gold).alias("__g"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    words = F.concat(
        F.transform(tokens(F.col("__p")), lambda t: F.struct(t.alias("w"), one.alias("p"), none.alias("g"))),
        F.transform(tokens(F.col("__g")), lambda t: F.struct(t.alias("w"), none.alias("p"), one.alias("g"))),
    )
    exact = (F.col("__p") == F.col("__g")).cast("int")
    counts = (
        texts.select(*keys, exact.alias("exact_match"), F.explode_outer(words).alias("__x"))
        .groupBy(*keys, "exact_match", F.col("__x.w").alias("__w"))
        .agg(F.sum("__x.p").alias("__np"), F.sum("__x.g").alias("__ng"))
    )
    sums = counts.groupBy(*keys, "exact_match").agg(
        F.coalesce(F.sum(F.least("__np", "__ng")), none).alias("__s"),
        F.coalesce(F.sum("__np"), none).alias("__np"),
        F.coalesce(F.sum("__ng"), none).alias("__ng"),
    )
    return sums.select(*keys, "exact_match", bag_f1_from_counts(F.col("__s"), F.col("__np"), F.col("__ng")).alias("f1"))
