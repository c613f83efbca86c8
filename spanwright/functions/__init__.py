"""Part of spanwright."""
