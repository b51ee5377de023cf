"""Sources: Parquet trees, file listings, nested zip archives, CSV dimensions."""
