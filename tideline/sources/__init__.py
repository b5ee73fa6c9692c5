"""External tables: CSV, JSON, Parquet files and databases."""
