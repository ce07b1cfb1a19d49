"""Column expressions: colour, height, hashing and small linear algebra."""
