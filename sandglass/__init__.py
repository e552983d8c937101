"""sandglass: Spark-native corpus sampling, auditing and budget analytics."""

__version__ = "0.1.0"
