"""Operators for training-data pipelines: mixing, sharding, classifiers, deduplication, token files and filters."""
