"""operators of docflow."""
