"""streaming of the trajectory dataset library."""
