"""A Spark-first engine for discourse, graph and text analytics."""
