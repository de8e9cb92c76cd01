"""Column expressions that Catalyst plans like its own."""
