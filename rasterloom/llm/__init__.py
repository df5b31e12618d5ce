"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
