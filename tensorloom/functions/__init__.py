"""Column functions: IEEE arithmetic, packed vectors, quaternions."""
