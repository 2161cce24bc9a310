"""Readers of the engine's tables and of external content."""
