"""Spark-native analytics over corpora that are text, graph and vectors at once."""
