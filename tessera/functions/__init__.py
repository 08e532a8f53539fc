"""See the package docstring of tessera."""
