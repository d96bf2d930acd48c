"""Synthetic scenarios: traffic, injected cases, faults, and the comparison of what was found with what should be."""
