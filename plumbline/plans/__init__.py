"""Catalyst's unresolved plans: walking, guarding and checking them."""
