"""Expressions of rules as Spark columns."""
