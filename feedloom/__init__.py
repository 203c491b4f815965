"""Feedback analytics on Spark: DataFrame-first operators over review-style text."""
