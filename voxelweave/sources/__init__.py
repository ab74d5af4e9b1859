"""Readers and writers of the engine's file formats; tables live in Parquet."""
