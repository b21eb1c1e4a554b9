"""A PySpark engine for clustering noisy point observations."""
