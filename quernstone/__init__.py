"""Quernstone: a Spark-native engine for document ingest, retrieval and evaluation."""
