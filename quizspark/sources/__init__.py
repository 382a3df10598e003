"""sources of the evaluation analytics library."""
