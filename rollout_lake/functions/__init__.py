"""Column builders and the registries of scoring functions."""
