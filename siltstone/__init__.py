"""Spark operators for instance-discovery data and for training-data preparation."""
