"""A PySpark-native engine for curating and querying per-user text memories."""
