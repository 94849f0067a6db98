"""The query catalogue: every registered query with its SQL check."""
