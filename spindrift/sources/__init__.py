"""Event tables and where they come from."""
