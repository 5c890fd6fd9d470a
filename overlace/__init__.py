"""Overlace: hypergraph analytics as Spark DataFrame plans."""
