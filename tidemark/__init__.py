"""tidemark: a PySpark-native time-series research and corpus-preparation engine."""
