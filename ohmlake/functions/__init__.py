"""Column functions and small table idioms that the operators share."""
