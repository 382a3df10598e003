"""functions of the evaluation analytics library."""
