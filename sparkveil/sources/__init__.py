"""Readers and writers. Every reader that keeps row order adds a dense ``_row``."""
