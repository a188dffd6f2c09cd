"""Reading files, and the stored index."""
