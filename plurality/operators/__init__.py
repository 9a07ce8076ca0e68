"""Operators: scoring, shares, evidence, ensemble grid, packed decoding,
classification and the rule audit, each a DataFrame -> DataFrame plan."""
