"""Span analytics on Spark: traces, call graphs, baselines, incidents."""
