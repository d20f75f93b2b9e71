"""Column expressions: all built from native Spark functions, no UDF."""

from bicspark.functions.numeric import (
    population_variance,
    round_half_up,
    running_mean,
    sum_mean,
)
from bicspark.functions.text import concept_text, row_text, triple_text

__all__ = [
    "concept_text",
    "population_variance",
    "round_half_up",
    "row_text",
    "running_mean",
    "sum_mean",
    "triple_text",
]
