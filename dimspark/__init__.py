"""Unit-aware analytics on Spark: physical units ride in column metadata."""
