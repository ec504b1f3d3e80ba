"""Requests compiled to lazy frames."""
