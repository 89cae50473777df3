"""sources of docflow."""
