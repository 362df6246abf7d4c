"""functions of the trajectory dataset library."""
