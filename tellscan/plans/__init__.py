"""plans of the prose-lint engine."""
