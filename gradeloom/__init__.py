"""Spark-native evaluation of model response logs and template routers."""
