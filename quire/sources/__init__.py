"""Readers of book containers and library tables."""
