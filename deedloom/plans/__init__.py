"""plans of deedloom."""
