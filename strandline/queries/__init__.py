"""The registered queries over the given tables, each beside its DuckDB twin."""
