"""A PySpark-native engine for map-style object data: points, paths over them, groups of both."""
