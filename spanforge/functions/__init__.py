"""Column functions: intervals, sequences, vectors and names. All of them are built-in expressions."""
