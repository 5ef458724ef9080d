"""functions of the prose-lint engine."""
