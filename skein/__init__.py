"""Skein: analytics on changing graphs, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
