"""streaming of docflow."""
