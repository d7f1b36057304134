"""Bipartite binding analytics expressed as Spark DataFrame plans."""
