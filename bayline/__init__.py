"""Spark-native occupancy and detection-quality analytics."""
