"""lexforge: a Spark-native engine for corpus building and benchmark analytics."""
