"""Process-telemetry analytics on Spark's DataFrame, SQL and Structured Streaming APIs."""
