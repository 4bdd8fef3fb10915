"""Tabular statistics and yield modelling as Spark DataFrame operators."""
