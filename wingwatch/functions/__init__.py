"""Pure column expressions (no jobs are triggered here)."""
