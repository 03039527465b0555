"""Column-level building blocks: derivations, measures and skew-safe sequences."""
