"""Live paths over Structured Streaming."""
