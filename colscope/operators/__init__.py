"""Operators over rows and footers; each returns a DataFrame unless it writes."""
