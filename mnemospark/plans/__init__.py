"""plans of the memory analytics engine."""
