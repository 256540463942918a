"""Operators for preparing training text, one module each; ``queries`` registers them.

Nothing else in the package imports this folder.
"""
