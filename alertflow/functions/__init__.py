"""Column functions (F1-F23): built-in Catalyst expressions only."""
