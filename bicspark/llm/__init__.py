"""Operators of a training-data pipeline: search, deduplication, mixing, packing, scoring.

Each module is one operator; :mod:`bicspark.llm.queries` registers them. Operators read
the columns they name and no others, so extra columns of any name are ignored.
"""
