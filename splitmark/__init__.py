"""Splitmark: breakpoint analytics over aligned reads, as Spark DataFrame operators."""
