"""Schemaless SQL on Spark: a compact SQL dialect over JSON documents and Parquet tables."""
