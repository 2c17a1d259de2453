"""Readers and writers for bar datasets, manifests, reports and the event log."""
