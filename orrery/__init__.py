"""Spark-native analytics over ordered sensor-style data: poses, boxes, tracks, sequences and rankings."""
