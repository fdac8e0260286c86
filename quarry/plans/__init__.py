"""Plan-shape helpers (join strategy, per-group top-k) and composite queries."""
