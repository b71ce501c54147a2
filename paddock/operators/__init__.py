"""Operators: joins, aggregations, windows, reports and sinks."""
