"""Reusable plan shapes: skew-safe joins, prefix sums, top-k."""
