"""Column functions: times, angles, vectors."""
