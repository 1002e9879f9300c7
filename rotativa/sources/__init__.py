"""Reading and writing corpora and feature blocks."""
