"""sources of deedloom."""
