"""Configuration texts and control requests."""
