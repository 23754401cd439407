"""Column functions: text, patterns, urls, names, dates and numbers."""
