"""Column expressions: tokenising, stemming, URLs, snippets."""
