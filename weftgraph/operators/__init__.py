"""Relational, graph, search, resolution and analysis operators over fact DataFrames."""
