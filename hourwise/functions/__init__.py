"""Column-level helpers (expressions, naming rules)."""
