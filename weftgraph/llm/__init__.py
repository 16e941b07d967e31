"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`weftgraph.llm.registry`.
"""
