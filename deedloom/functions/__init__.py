"""functions of deedloom."""
