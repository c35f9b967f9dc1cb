"""millrace: Spark-native operators for product telemetry and code corpora."""

__version__ = "0.1.0"
