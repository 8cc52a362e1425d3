"""Change observation with Structured Streaming."""
