"""DataFrame operators: joins, windows, aggregates, rules, merging, privacy, plans."""
