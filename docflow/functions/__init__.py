"""functions of docflow."""
