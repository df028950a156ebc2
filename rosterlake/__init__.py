"""Spark-native workforce warehouse: staging, operational layer, star schema and analytics."""
