"""Semantic inference, triples, mappings, fact builders and chart data."""
