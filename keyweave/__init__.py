"""Keyed collections, logs and queues as relations on Spark."""
