"""Telemetry processing as ordinary Spark DataFrames and streams."""
