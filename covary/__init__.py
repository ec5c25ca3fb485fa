"""Covary: PySpark-native analytics for panels of series that move together."""
