"""Functions of the ingest and digest engine."""
