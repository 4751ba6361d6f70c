"""A PySpark-native engine for tile algebra, similarity search and the analytics around them."""
