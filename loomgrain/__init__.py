"""loomgrain: a Spark-native engine for feedback-driven dataset construction."""

__all__ = ["runtime"]
