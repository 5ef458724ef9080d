"""Row-level text operators: spans, blanking, positions, context, notes."""
