"""Continuous ingest of book files (an extension of the batch readers)."""
