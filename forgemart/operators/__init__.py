"""DataFrame-level building blocks: joins, generators, totals and quality checks."""
