"""Spark-native analytics for crystal catalogues and configuration ensembles."""
