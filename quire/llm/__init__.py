"""Operators for building training corpora; nothing outside imports this subpackage."""
