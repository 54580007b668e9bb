"""Spark-first analytics for regularly sampled multi-channel time series."""
