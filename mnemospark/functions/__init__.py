"""functions of the memory analytics engine."""
