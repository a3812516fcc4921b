"""Operators for training data: matching, cleaning, screening and encoding of text.

Nothing outside this subpackage imports it.
"""
