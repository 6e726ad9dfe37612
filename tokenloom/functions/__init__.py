"""Column functions: everything here works inside one row."""
