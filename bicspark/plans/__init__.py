"""Whole jobs built from the operators, and the stage tables they share."""

from bicspark.plans.stages import Stages

__all__ = ["Stages"]
