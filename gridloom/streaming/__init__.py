"""Structured Streaming: operators on complete chunks, running counts, and running per-channel state."""
