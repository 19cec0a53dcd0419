"""Where rows and footers come from, and where rows go."""
