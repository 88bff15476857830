"""Lap-telemetry analytics on Spark: column-parameterised DataFrame -> DataFrame operators."""

__version__ = "0.1.0"
