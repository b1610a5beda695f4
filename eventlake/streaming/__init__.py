"""streaming of the event catalogue engine."""
