"""Named queries, DuckDB oracle SQL and MLlib pipelines."""
