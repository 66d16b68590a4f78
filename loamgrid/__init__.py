"""Spark-native engine for paged documents: segmentation, retrieval, grading and corpus preparation."""
