"""Index, ranking, facet, page and crawl operators."""
