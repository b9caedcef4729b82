"""DataFrame operators of retrieval, pruning, scoring and sampling."""
