"""The stages of a rule as DataFrame operations: bind, match, join, project, and what follows."""
