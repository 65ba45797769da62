"""Readers for the engine's input tables."""

from corvane.sources.tables import read_table

__all__ = ["read_table"]
