"""Spark-first engine for preparing, modelling and monitoring measurement data."""
