"""Quillon: a learning-analytics engine written as plain Spark DataFrame functions."""
