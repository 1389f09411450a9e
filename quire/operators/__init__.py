"""DataFrame operators over books, chapters and the library tables."""
