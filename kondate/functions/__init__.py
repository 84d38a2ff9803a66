"""Column functions: text, addresses, HTML and nutrition extraction."""
