"""Operators of a pipeline that prepares training text: filters, deduplication, mixing, packing."""
