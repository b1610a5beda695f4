"""functions of the event catalogue engine."""
