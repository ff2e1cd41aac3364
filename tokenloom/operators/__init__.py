"""DataFrame operators: ordering, tokenizing, splitting, sharding, batching, reporting."""
