"""PySpark-native analytics for interval sets, sequences and vectors."""
