"""Spark-native analytics for candidate curation and training-data preparation."""
