"""Operators for building training data at scale.

Nothing outside this subpackage imports it; it can be deleted and the rest of
the library still works.
"""
