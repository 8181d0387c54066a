"""Operators: import resolution, the dependency graph, type shapes, analyzers."""
