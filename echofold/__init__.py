"""Spark-first analytics for networks of independently clocked acoustic sensors."""
