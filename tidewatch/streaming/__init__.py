"""Rules over streams."""
