"""Column-level building blocks: row digests, names, statuses, fixed values."""
