"""Query catalogue and strategy choice."""
