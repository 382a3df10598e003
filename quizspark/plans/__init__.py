"""plans of the evaluation analytics library."""
