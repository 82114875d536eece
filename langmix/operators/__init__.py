"""DataFrame operators: corpus, cleaning, sampling, ordering, tagging, alignment,
scoring, metrics, keyed tables and profiles."""
