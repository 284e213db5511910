"""Operators for training-data pipelines over whole corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its
queries only where it is present.
"""
