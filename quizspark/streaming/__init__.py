"""streaming of the evaluation analytics library."""
