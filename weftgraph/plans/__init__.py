"""Queries over the driver tables: the lens that views them as code facts, and the registry."""
