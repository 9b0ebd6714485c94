"""The three workflows: ingest, simulate, evaluate."""
