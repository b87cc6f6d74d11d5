"""Scans and sinks: CSV and Parquet tables, image files, result tables."""
