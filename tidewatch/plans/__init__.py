"""Plans of rules: what a rule needs from its events, and which strategy runs it."""
