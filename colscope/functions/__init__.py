"""Scalar helpers: units, rendering, column selectors, SQL dialect functions."""
