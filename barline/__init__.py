"""barline: a PySpark-native analytics engine for market time series."""
