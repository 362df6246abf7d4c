"""sources of the trajectory dataset library."""
