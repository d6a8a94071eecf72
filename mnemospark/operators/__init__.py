"""operators of the memory analytics engine."""
