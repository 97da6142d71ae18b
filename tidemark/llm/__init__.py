"""Operators for preparing training text at scale.

Nothing outside this subpackage (and the repository's entry module) imports it.
"""
