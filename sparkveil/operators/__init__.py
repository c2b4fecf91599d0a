"""Operators over DataFrames: scanning, protection, restoring, classification, charts, reports, evaluation."""
