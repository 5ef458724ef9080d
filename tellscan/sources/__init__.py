"""sources of the prose-lint engine."""
