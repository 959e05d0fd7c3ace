"""Column functions and join helpers shared by the operators."""
