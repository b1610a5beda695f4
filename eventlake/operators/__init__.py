"""operators of the event catalogue engine."""
