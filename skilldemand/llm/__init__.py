"""Operators for training-data pipelines over the documents, labels, benchmark and pages tables."""
