"""A small language for synthetic signals."""
