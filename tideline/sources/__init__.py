"""sources of the event-state engine."""
