"""Incremental form of the prediction/outcome log."""
