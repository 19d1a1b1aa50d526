"""albumspark: a PySpark-native engine for photo and video metadata."""
