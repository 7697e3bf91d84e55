"""Physical building blocks: joins, grouping, ranking."""
