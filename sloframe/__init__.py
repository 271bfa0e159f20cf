"""sloframe: Spark-native analytics over evaluation, request and training logs."""

__version__ = "0.1.0"
