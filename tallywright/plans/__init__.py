"""End-to-end evaluations, test adapters and the registered queries."""
