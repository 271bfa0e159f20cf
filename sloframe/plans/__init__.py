"""Registered queries over the driver tables."""

from sloframe.plans import agreement, curves, data, files, scoring, slo, stream, text  # noqa: F401
from sloframe.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
