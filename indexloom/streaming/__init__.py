"""Keep an index up to date from a stream of files."""
