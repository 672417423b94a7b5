"""A PySpark-native engine for evaluating anomaly detectors and the data they run on."""
