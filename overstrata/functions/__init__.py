"""See the package docstring of ``overstrata``."""
