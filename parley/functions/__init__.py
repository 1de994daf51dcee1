"""Column-level building blocks: everything here takes and returns Columns."""
