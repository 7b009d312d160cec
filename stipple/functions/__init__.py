"""Column functions: portable random numbers, array arithmetic."""
