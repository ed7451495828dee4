"""Structured Streaming versions of ingestion, replay and attribution."""

#: Trigger of a stream that takes what is there and ends; give ``{"processingTime": "1 second"}`` to tail for ever.
ONCE = {"availableNow": True}
