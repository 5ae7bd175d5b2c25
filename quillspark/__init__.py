"""Labelled-lake analytics on Spark."""
