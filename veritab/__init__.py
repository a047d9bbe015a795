"""A Spark-native engine that reconciles facts stated across related documents."""
