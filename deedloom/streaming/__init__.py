"""streaming of deedloom."""
