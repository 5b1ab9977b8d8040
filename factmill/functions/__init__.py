"""Column functions: text, contact data, urls, identity, statistics and cost."""
