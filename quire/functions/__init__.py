"""Column functions: text, markup, titles, rules."""
