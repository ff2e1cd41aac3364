"""Column functions.  All of them are plain Catalyst expressions."""
