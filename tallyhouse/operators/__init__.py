"""The analytics operators, grouped by subject."""
