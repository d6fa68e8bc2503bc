"""Operators: transforms, flow conditions, grouping, windows, aggregations, triggers and patterns."""
