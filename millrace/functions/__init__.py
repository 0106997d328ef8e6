"""Column-level building blocks (no actions, no DataFrames)."""
