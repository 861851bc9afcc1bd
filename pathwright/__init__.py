"""pathwright: a PySpark-native engine for verified-trajectory data."""
