"""Column functions of the pool model."""
