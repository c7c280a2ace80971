"""PySpark-native engine for importing, linking, merging, de-duplicating and auditing records."""
