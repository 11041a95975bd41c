"""Table sources and sinks (parquet driver tables, CSV/JSON files, text grids)."""
