"""Operators for preparing language-model training data.

Nothing outside this package imports it; deleting it leaves the rest of the
engine working.
"""
