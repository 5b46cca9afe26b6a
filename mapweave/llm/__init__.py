"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage; it depends on the rest of
the library for nothing either, so the two can be installed apart.
"""
