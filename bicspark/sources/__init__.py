"""Text and table sources and sinks."""

from bicspark.sources.read import number_lines, read_buckets, read_matrix, read_prepared
from bicspark.sources.write import (
    bucket_lines,
    concept_lines,
    prepared_lines,
    write_concepts,
    write_stage,
)

__all__ = [
    "bucket_lines",
    "concept_lines",
    "number_lines",
    "prepared_lines",
    "read_buckets",
    "read_matrix",
    "read_prepared",
    "write_concepts",
    "write_stage",
]
