"""Spark-native analytics over code graphs, review findings and audit logs."""
