"""keelson: a PySpark-native engine for scene-graph alignment and registration evidence."""

__version__ = "0.1.0"
