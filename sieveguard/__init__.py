"""Selective-escalation anomaly analytics for sensor streams, on Spark DataFrames."""
