"""sources of the memory analytics engine."""
