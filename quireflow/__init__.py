"""PySpark-native engine that turns positioned document words into structured Markdown."""
