"""Readers, table maintenance and exports."""
