"""streaming of the prose-lint engine."""
