"""operators of the event-state engine."""
