"""Where events come from and where alerts go."""
