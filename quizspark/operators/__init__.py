"""operators of the evaluation analytics library."""
