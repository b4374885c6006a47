"""Capture analytics on Spark: from browser network captures to comparable run records."""

#: Stamps of run records: their shape, and the computation behind them.
SCHEMA_VERSION = 1
ANALYZER_VERSION = "1.0"
