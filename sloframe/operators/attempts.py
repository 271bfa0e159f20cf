"""Roll-ups inside one request record and its flat form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(attempts: Column) -> Column:
    """Struct of sums and counts over an array of struct(latency_ms, tokens_out,
    repaired, index); attempts after the first are retries."""
    n = F.size(attempts)
    return F.struct(
        n.alias("attempts"),
        F.aggregate(attempts, F.lit(0.0), lambda acc, a: acc + F.coalesce(a["latency_ms"], F.lit(0.0))).alias("total_latency_ms"),
        F.aggregate(attempts, F.lit(0).cast("bigint"), lambda acc, a: acc + F.coalesce(a["tokens_out"].cast("bigint"), F.lit(0))).alias("total_tokens"),
        F.greatest(n - 1, F.lit(0)).alias("retries"),
        F.size(F.filter(attempts, lambda a: F.coalesce(a["repaired"], F.lit(False)))).alias("repairs"),
    )


def validation_ms(timings: Column) -> Column:
    """End minus start of validation; 0 when the end was not recorded."""
    end, start = (F.try_element_at(timings, F.lit(k)) for k in ("validation_end", "validation_start"))
    return F.coalesce(end - F.coalesce(start, F.lit(0.0)), F.lit(0.0))


def mean_logprob(logprobs: Column) -> Column:
    """Mean token log probability; NULL without any."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.size(known))


def flatten_episode(df: DataFrame, columns: Sequence[str], metrics: Sequence[str], parsed: dict[str, tuple[str, str]], preview: int = 1000) -> DataFrame:
    """Wide rows: plain columns, one column per metric (NULL if absent), chosen
    paths of the parsed output, the raw output and its first ``preview`` characters."""
    return df.select(
        *columns,
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics],
        *[F.try_variant_get("parsed_output", path, kind).alias(name) for name, (path, kind) in parsed.items()],
        "raw_output",
        F.substring("raw_output", 1, preview).alias("raw_preview"),
    )
