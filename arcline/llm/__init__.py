"""Operators for preparing training data: near copies, sharding, scoring, search, mixing and formatting."""
