"""Sources: JSON documents by JSONPath, JSON lines, Parquet and other DataFrames, and the catalog of their names."""
