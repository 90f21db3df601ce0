"""Spark-native analytics over trade-shipment records, and corpus preparation."""
