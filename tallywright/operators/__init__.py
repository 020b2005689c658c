"""DataFrame operators: result-set comparison, execution, aggregation, reports."""
