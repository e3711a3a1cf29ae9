"""Descriptive analytics for tables, series, text and arrays, written as Spark DataFrame jobs."""
