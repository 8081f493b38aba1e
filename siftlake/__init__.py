"""siftlake: a Spark-first engine for feature search and run analytics."""
