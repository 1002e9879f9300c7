"""The row-local operators on arriving articles."""
