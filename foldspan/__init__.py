"""Spark-first analytics over ordered, multi-participant event logs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
