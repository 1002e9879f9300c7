"""Operators for training-data pipelines: secrets, archives, tokens, page text, languages, personal data, language
models, near duplicates and benchmark leaks. Nothing else in the library imports this package."""
