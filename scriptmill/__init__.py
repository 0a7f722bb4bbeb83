"""scriptmill: a PySpark-native engine for mixed-script token streams."""
