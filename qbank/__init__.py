"""qbank: a PySpark-native analytics engine for banks of exam problems."""
