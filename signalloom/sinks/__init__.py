"""Keyed Parquet sinks: append, upsert, replace, first-writer and priority."""
