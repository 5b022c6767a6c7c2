"""plans of the analytics engine."""
