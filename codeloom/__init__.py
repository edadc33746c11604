"""codeloom: a PySpark-native analytics engine over source code and its graph."""
