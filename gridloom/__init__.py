"""Weighted two-dimensional array streams on Spark: grids, operators, pipelines, sources, sinks, streaming."""
