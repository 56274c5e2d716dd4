"""glyphmill: a PySpark-native text-corpus engine."""
