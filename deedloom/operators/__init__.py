"""operators of deedloom."""
