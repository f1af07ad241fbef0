"""Spark-native analytics for tables, sheets and text taken out of documents."""
