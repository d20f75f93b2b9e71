"""Biclusters of large numeric matrices as Spark DataFrame jobs."""
