"""Operators of a training-data pipeline: packing, token files, near and exact
duplicates, chat rendering, secrets, mixing, repeated passages, PII and quality.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries when it is there.
"""
