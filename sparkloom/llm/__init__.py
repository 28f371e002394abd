"""Operators for large text collections used to train language models.

Nothing outside this package imports it.
"""
