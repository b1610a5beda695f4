"""sources of the event catalogue engine."""
