"""isobath: a Spark-native engine for physics-based modelling over tables."""
