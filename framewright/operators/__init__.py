"""operators of the trajectory dataset library."""
