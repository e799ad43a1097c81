"""The SQL catalog, pairs of plans for one question, and what EXPLAIN says of them."""
