"""Bindings of the provided tables, lake reads/writes and topic records."""
