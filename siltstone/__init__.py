"""siltstone: a PySpark-native engine for content-intelligence dataflows."""
