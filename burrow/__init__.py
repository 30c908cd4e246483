"""A Spark-native engine for schemaless document collections."""
