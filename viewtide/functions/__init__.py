"""See the package docstring of viewtide."""
