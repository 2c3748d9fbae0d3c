"""Operators for training data of language and image-text models.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
