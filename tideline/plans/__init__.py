"""plans of the event-state engine."""
