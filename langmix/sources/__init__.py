"""Readers, sinks and the incremental JSON-array Data Source."""
