"""End-to-end tables, each one lazy plan over its input tables."""
