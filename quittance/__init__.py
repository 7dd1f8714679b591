"""A PySpark-native analytics engine for financial documents."""
