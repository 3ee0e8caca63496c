"""Keyed-event features, publication, labels, evaluation and corpus preparation on Spark."""
