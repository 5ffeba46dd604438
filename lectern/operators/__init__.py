"""DataFrame operators: records, layout, phrases, ranking and table merges."""
