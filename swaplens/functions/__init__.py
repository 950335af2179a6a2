"""Column expressions shared by operators."""
