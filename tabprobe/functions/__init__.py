"""Column expressions: keyed randomness, text and number rules, result-record rules."""
