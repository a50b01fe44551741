"""Column expressions: no DataFrame in, no action, everything stays in Catalyst."""
