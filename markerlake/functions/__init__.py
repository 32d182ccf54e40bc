"""Scalar functions built from Spark columns."""
