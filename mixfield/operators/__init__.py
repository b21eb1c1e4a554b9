"""Relational operators on points, components and responsibilities."""
