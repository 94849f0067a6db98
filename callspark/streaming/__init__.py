"""Structured Streaming forms of the import and the KPI refresh."""
