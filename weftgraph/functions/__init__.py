"""Column factories used by the operators."""
