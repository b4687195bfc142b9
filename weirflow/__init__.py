"""Typed columnar tables on Spark."""
