"""Fact sources and sinks: tables, source trees, extraction."""
