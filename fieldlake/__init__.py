"""fieldlake: a PySpark-native analytics engine for field-recording archives."""

__version__ = "0.1.0"
