"""functions of the event-state engine."""
