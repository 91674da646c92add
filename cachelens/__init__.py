"""Spark-native analytics for fleets of distributed key-value caches."""
