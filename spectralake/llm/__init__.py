"""Operators for building text and embedding training sets, each a Spark job."""
