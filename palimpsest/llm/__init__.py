"""Training-data operators: one module for each, `registry` for their queries."""
