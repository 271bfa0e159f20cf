"""Named transforms that users register and apply by name.

A plugin is a function DataFrame -> DataFrame (used with ``df.transform``) or a
scorer, Column -> Column. Logic that no built-in function expresses can be a
``pandas_udf`` inside a scorer, which works on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

Transform = Callable[[DataFrame], DataFrame]
Scorer = Callable[..., Column]
_TRANSFORMS: dict[str, Transform] = {}
_SCORERS: dict[str, Scorer] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    def add(fn: Transform) -> Transform:
        _TRANSFORMS[name] = fn
        return fn

    return add


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(fn: Scorer) -> Scorer:
        _SCORERS[name] = fn
        return fn

    return add


def get_transform(name: str) -> Transform:
    if name not in _TRANSFORMS:
        raise KeyError(f"no transform {name!r}; known: {sorted(_TRANSFORMS)}")
    return _TRANSFORMS[name]


def get_scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise KeyError(f"no scorer {name!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name]


def apply_scorers(df: DataFrame, scorers: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add one column per scorer name, called with the given columns."""
    from pyspark.sql import functions as F

    return df.withColumns({name: get_scorer(name)(*[F.col(c) for c in columns]) for name, columns in scorers.items()})
