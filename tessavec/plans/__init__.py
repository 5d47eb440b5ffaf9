"""Predicates and how they become plans."""
