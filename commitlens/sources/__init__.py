"""Ingest: NDJSON parsing, normalisation and driver-table bindings."""
