"""Live feeds."""
