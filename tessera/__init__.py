"""Spark-native feature analytics: role-typed columns, encoders, windows, profiling, evaluation."""
