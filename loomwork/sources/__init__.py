"""Reading and writing what isn't Parquet."""
