"""Measuring signals in dated text, and testing what they are worth, on Spark."""
