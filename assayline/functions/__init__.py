"""Column functions: predicates, text, patterns, dates and the few Arrow functions."""
