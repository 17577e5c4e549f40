"""General DataFrame operators: rows, encoding, statistics, ordered totals, neighbours."""
