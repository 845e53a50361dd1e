"""The same word scoring over Structured Streaming (an extension)."""
