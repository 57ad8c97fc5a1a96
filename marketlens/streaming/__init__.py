"""The same behaviours over streams, with Structured Streaming."""
