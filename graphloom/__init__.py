"""A Spark-native engine for metadata graphs, scoring, loyalty data and training text."""
