"""Compute a value once and use it many times inside one expression.

Spark removes repeated subexpressions only outside lambdas and conditional
branches. A one-element ``transform`` binds the value to a lambda variable, so a
parsed record or a token array is built once however often the body reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Bind several values; the body reads them as fields of one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
