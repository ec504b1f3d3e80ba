"""Filters, ordering, lookups and keyed changes."""
