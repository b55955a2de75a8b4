"""Corpus operators for training data, each a Spark job over a whole table."""
