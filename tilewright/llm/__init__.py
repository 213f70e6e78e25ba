"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
