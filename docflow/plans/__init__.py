"""plans of docflow."""
