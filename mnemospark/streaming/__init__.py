"""streaming of the memory analytics engine."""
