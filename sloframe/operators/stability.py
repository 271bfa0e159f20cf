"""Agreement of repeated outputs and vote selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_agreement(df: DataFrame, prompt: Sequence[str], output: Column, min_runs: int = 2) -> DataFrame:
    """Per prompt: runs, distinct outputs, share of the most frequent output.

    Outputs are counted first, so a prompt with very many runs arrives at its
    task as one row per distinct output and map task.
    """
    counts = df.groupBy(*prompt, output.alias("__out")).agg(F.count(F.lit(1)).alias("__c"))
    return (
        counts.groupBy(*prompt)
        .agg(F.sum("__c").alias("runs"), F.count(F.lit(1)).alias("distinct_outputs"), F.max("__c").alias("mode_count"))
        .where(F.col("runs") >= min_runs)
        .withColumn("agreement", F.col("mode_count") / F.col("runs"))
        .withColumn("disagreement", 1.0 - F.col("agreement"))
    )


def disagreement(df: DataFrame, by: Sequence[str], prompt: Sequence[str], output: Column, min_runs: int = 2) -> DataFrame:
    """Means over prompts with at least ``min_runs`` runs, per group."""
    keys = [*by, *[p for p in prompt if p not in by]]
    per = prompt_agreement(df, keys, output, 1)
    enough = F.col("runs") >= min_runs
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.count_if(enough).alias("num_groups_used"),
        F.avg(F.when(enough, F.col("agreement"))).alias("agreement_rate"),
        F.avg(F.when(enough, F.col("disagreement"))).alias("disagreement_at_k"),
    )


def distinct_disagreement(df: DataFrame, by: Sequence[str], prompt: Sequence[str], output: Column) -> DataFrame:
    """Mean of 1 - max(1, n - distinct + 1) / n over prompts with two runs or more."""
    keys = [*by, *[p for p in prompt if p not in by]]
    per = prompt_agreement(df, keys, output, 2)
    n, u = F.col("runs"), F.col("distinct_outputs")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.avg(1.0 - F.greatest(F.lit(1), n - u + 1) / n).alias("disagreement"),
    )


def majority_vote(df: DataFrame, prompt: Sequence[str], output: Column, valid: Column, attempt: Column, mode: str = "majority") -> DataFrame:
    """One selected attempt per prompt.

    ``majority``: the valid output with most votes, ties to the one seen first, at
    its first attempt. ``first_valid``: the first valid attempt. Without any valid
    attempt the last one is taken.
    """
    counts = df.groupBy(*prompt, output.alias("__out")).agg(
        F.count_if(valid).alias("__votes"),
        F.min(F.when(valid, attempt)).alias("__first"),
        F.max(attempt).alias("__last"),
    )
    pick = F.struct(F.col("__out").alias("output"), F.col("__first").alias("attempt"), F.col("__votes").alias("votes"))
    order = F.struct(F.col("__votes"), -F.col("__first")) if mode == "majority" else F.struct(-F.col("__first"))
    any_valid = F.col("__votes") > 0
    last = F.max_by(F.struct(F.col("__out").alias("output"), F.col("__last").alias("attempt"), F.lit(0).cast("bigint").alias("votes")), F.col("__last"))
    chosen = counts.groupBy(*prompt).agg(
        F.coalesce(F.max_by(F.when(any_valid, pick), F.when(any_valid, order)), last).alias("__p"),
        F.sum("__votes").alias("valid_attempts"),
    )
    return chosen.select(*prompt, "__p.output", "__p.attempt", "__p.votes", "valid_attempts")
