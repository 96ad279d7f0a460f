"""lorekeel: a PySpark-native engine that links text to a typed, temporal knowledge graph."""

__version__ = "0.1.0"
