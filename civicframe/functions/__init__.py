"""Column functions: missing-value rules, text, dates, planar geometry."""
