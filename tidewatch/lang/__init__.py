"""The three small languages: window schemas, rules and scenarios."""
