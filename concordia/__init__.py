"""A PySpark-native engine that reconciles, corrects, verifies and exports records read by several readers."""
