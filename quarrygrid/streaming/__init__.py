"""Feeds of changes, and windows of event time."""
