"""Operators for preparing language-model training text: deduplication, filters, sharding, encoding, archives."""
