"""Operators that prepare training text: quality, de-duplication, packing, archives and more."""
