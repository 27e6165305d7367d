"""DataFrame operators: features, statistics, encodings, ranks, splits, reports."""
