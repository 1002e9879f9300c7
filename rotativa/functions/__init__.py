"""Column functions: row-local, no shuffle, usable in batch and streaming plans."""
