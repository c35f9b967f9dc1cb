"""Queries over the data folder's tables: one module per family, each with ``QUERIES`` and ``SQL``."""

MODULES = ["problems", "telemetry", "corpus", "feeds", "rollups"]
