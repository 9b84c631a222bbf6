"""DataFrame operators of the redaction dataflow."""
