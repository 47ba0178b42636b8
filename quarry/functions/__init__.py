"""Column functions for text, paths and globs."""
