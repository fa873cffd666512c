"""Output streams as tables."""
