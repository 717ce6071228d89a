"""A Spark-native engine for diagnosing agent traces: rule scans, evidence checks, reports and scoring as DataFrame plans."""

__version__ = "0.1.0"
