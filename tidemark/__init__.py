"""tidemark: Spark-native news-sentiment indexing, validation and corpus operators."""
