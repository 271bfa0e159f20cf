"""Row filters on status and level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log levels from least to most severe, and failed run states.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
FAILED = ("oom_failed", "error")


def level_number(level: Column) -> Column:
    """Place of a level name; an unknown or missing one counts as INFO."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(level))
    return F.when(place > 0, place).otherwise(LEVELS.index("INFO") + 1)


def at_least_level(df: DataFrame, level: str, minimum: str) -> DataFrame:
    return df.where(level_number(F.col(level)) >= LEVELS.index(minimum.upper()) + 1)


def failed(df: DataFrame, status: str, states: Sequence[str] = FAILED) -> DataFrame:
    return df.where(F.col(status).isin(*states))
