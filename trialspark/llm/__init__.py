"""Operators for preparing training text: counting, encoding, filtering, joining, packing."""
