"""Reading inputs and writing intermediate tables."""
