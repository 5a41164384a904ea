"""Spark-native record de-identification, compliance screening and corpus preparation."""
