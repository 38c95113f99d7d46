"""Operators for preparing training data: rules, near-duplicates, personal data, packing, archives."""
