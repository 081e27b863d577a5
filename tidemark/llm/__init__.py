"""Operators that prepare a text corpus for training.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
