"""Queries: operators bound to the driver's tables, with their SQL."""
