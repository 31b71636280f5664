"""touchline: batch analytics for football tables, written for Spark."""

__version__ = "0.1.0"
