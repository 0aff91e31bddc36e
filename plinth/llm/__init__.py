"""Operators for preparing language-model training data, each a distributed Spark job."""
