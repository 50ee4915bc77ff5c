"""Live updates with Structured Streaming."""
