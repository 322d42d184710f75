"""Logs, topics, queues, routing and feeds, in batch and as Structured Streaming."""
