"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage.
"""
