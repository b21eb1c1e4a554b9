"""Model steps, iterative drivers and registered queries."""
