"""Lineage analytics on Spark: labels, time bins, forecasts, backtests, score signals, sequences and audits."""
