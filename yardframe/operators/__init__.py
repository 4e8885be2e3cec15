"""DataFrame operators: joins, first-row, ranks, reshaping, exact cut points."""
