"""weftgraph: code-knowledge-graph and text analytics expressed as Spark plans."""
