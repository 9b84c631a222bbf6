"""Purpose-based redaction analytics on Spark."""
