"""Readers of feeds and filings, and sinks for tables that plain Parquet can hold."""
