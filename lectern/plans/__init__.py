"""Model boundaries and the registered queries."""
