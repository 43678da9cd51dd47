"""streaming of the event-state engine."""
