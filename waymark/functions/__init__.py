"""Plan-time functions."""
