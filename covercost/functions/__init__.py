"""Column -> Column functions (scalar rules), all built-in expressions."""
