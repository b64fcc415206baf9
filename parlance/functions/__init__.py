"""Column functions: pure expressions without shuffles."""
