"""Ontology-guarded analytics on Spark."""
