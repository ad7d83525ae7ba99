"""Operators of a training-data pipeline (dedup, filters, tokens, archives)."""
