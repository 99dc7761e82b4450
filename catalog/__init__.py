"""Registered queries: library operators wired to the driver tables, with DuckDB oracles."""
