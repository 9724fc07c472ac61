"""strandlake: a PySpark-native analytics engine for pattern queries over aligned reads."""

__version__ = "0.1.0"
