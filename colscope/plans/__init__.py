"""SQL over auto-named tables."""
