"""Constants and column functions."""
