"""Find and repair improbable rows in large tables with Spark."""
