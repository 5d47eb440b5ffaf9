"""Operators on collections: search, filters, mutations, graphs."""
